"""Fill-in-the-middle, sharding and token alignment against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.llm.conftest import awkward_rows
from tidelog.llm import fill_middle, sharding, token_alignment
from tidelog.llm import queries as Q

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def local(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.orderBy("doc_id").collect()]


def awkward_texts() -> list[tuple]:
    return [(i, t or "") for i, t, *_ in awkward_rows()]


# fill in the middle


def plain_middle(doc_id, text: str) -> tuple:
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(output), sha(text)


def middle_rows(df) -> list[tuple]:
    from pyspark.sql import functions as F

    out = fill_middle.fill_in_middle(df)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    rows = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2(back, 256)).collect()
    return sorted(map(tuple, rows), key=str)


def test_fill_middle_query(spark, sf_dir, local):
    got = sorted(map(tuple, Q.op11_fill_middle(spark, sf_dir).collect()), key=str)
    assert got == sorted((plain_middle(*x) for x in local), key=str)
    assert {"psm", "spm", "plain"} == {r[2] for r in got}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    assert sorted(con.execute(Q.ORACLE_SQL["op11_fill_middle"]).fetchall(), key=str) == got


def test_fill_middle_awkward(spark, awkward):
    assert middle_rows(awkward) == sorted((plain_middle(*x) for x in awkward_texts()), key=str)
    pieces = ["<", "<P", "<P>", "a<S>b", "M>", "<<S", "S>x", "é<", "ab1中c", "a", "1", "\n", "\x00", "x" * 5000, "é" * 3000 + "b", "¡1 é" * 900, "^a", "a^", "auc^", "<SSS<P"]
    rows = [(None if i % 7 == 3 else i, p) for i, p in enumerate(pieces * 6)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    assert middle_rows(made) == sorted((plain_middle(*x) for x in rows), key=str)
    assert middle_rows(made.limit(0)) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aPSM<> 1é中\n\U0001f600", max_size=40))
def test_units_by_events(text):
    raw = text.encode()
    changes, marked = fill_middle.EventScanner().events(raw)
    units = fill_middle.Units(raw, changes)
    plain = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert units.count == len(plain)
    assert marked == any(s in text for s in fill_middle.SENTINELS)
    assert [units.position(r) for r in range(len(plain) + 1)] == [len("".join(plain[:r]).encode()) for r in range(len(plain) + 1)]


def test_fill_middle_sentinels_of_any_length(spark):
    from pyspark.sql import functions as F

    own = ("<|PRE|>", "<|SUF|>", "<|MID|>")
    rows = [(i, "some words, 12 more|> and <|PRE" * (i % 3)) for i in range(60)]
    out = fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), sentinels=own, plain=0)
    got = out.select("doc_id", "form", fill_middle.restored(F.col("output"), F.col("form"), own).alias("text")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == rows
    assert {"psm", "spm"} <= {r["form"] for r in got}
    with pytest.raises(ValueError):
        fill_middle.EventScanner(("é",))


# sharding


def check_shards(rows, inputs, shards=8):
    want = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in inputs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots, of = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append((r["slot"], (r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"])))
        of[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], shards)
    assert all(len(x) == 1 for x in of.values())
    for s, own in slots.items():
        assert 0 <= s < shards
        own.sort()
        assert [x[0] for x in own] == list(range(len(own)))
        assert [x[1] for x in own] == sorted(x[1] for x in own)


def test_sharding_query(spark, sf_dir, local):
    rows = Q.op12_sharding(spark, sf_dir).collect()
    check_shards(rows, local)
    draws = lambda i, s: int(hashlib.md5(f"{i}:{s}".encode()).hexdigest()[:13], 16)
    for r in rows:
        assert r["shard"] == max(range(8), key=lambda s: draws(r["doc_id"], s))
        assert r["grown_shard"] == max(range(9), key=lambda s: draws(r["doc_id"], s))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, Q.op12_sharding(spark, sf_dir).collect()))


def test_sharding_awkward(spark, awkward):
    check_shards(sharding.assign(awkward).collect(), awkward_texts())
    assert sharding.assign(awkward.limit(0)).collect() == []
    hot = [(7, "same")] * 500 + [(i, None) for i in range(200)] + [(None, "x")] * 3
    check_shards(sharding.assign(spark.createDataFrame(hot, "doc_id long, text string").repartition(5)).collect(), [(i, t or "") for i, t in hot])


def test_sharding_by_weight(spark):
    from pyspark.sql import functions as F

    keys = spark.range(20000)
    counts = lambda w: {r["s"]: r["count"] for r in keys.groupBy(sharding.shard_of(F.col("id"), w).alias("s")).count().collect()}
    got = counts([1, 2, 3, 4])
    assert all(abs(got[s] - 2000 * (s + 1)) < 300 for s in range(4))
    heavier = keys.select(sharding.shard_of(F.col("id"), [1, 2, 3, 4]).alias("a"), sharding.shard_of(F.col("id"), [1, 2, 6, 4]).alias("b"))
    assert heavier.filter("a <> b AND b <> 2").count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), [1, 0])


# token alignment


class Plain:
    """The contract by byte offsets, text by text."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
        self.a.encode_special_tokens = True
        symbols = token_alignment._byte_of_symbol()
        self.a_bytes = lambda i: bytes(symbols[c] for c in self.a.id_to_token(i))

    def b_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    def tokens(self, text: str) -> tuple[list, list]:
        whole = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if not text or b"".join(map(self.a_bytes, a)) != whole or b"".join(map(self.b_bytes, b)) != whole:
            return [], []
        return a, b

    def rows(self, inputs) -> list[tuple]:
        found, counts = [], Counter()
        for doc_id, text in inputs:
            a, b = self.tokens(text)
            spans = []
            for ids, of in ((a, self.a_bytes), (b, self.b_bytes)):
                at, own = 0, []
                for i in ids:
                    own.append((at, at + len(of(i)), i))
                    at += len(of(i))
                spans.append(own)
            ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
            groups, links, low, j = [], [], 0, 0
            by_group = [defaultdict(list), defaultdict(list)]
            for side in (0, 1):
                k = 0
                for _, e, i in spans[side]:
                    while e > ends[k]:
                        k += 1
                    by_group[side][k].append(i)
            groups = [f"{','.join(map(str, by_group[0][k]))}|{','.join(map(str, by_group[1][k]))}" for k in range(len(ends))]
            for s, e, i in spans[0]:
                while j and spans[1][j - 1][1] > s:
                    j -= 1
                while j < len(spans[1]) and spans[1][j][1] <= s:
                    j += 1
                k = j
                while k < len(spans[1]) and spans[1][k][0] < e:
                    links.append((i, spans[1][k][2]))
                    k += 1
            counts.update(links)
            found.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
        best = Counter()
        for (_, y), n in counts.items():
            best[y] = max(best[y], n)
        return sorted(((d, a, b, g, len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), s) for d, a, b, g, x, s in found), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = [
    "", " ", "  ", " x", "x ", "a  b", "a   b c", "a\n b", "a\n\n  b", "a\tb \t c", "tail  ", "\xa0 b", "a \xa0b", "a　 b", "a 　b", "a b", "ogham x",
    "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "▁", "ﬁ café 中文字 \U0001f600\U0001f600 ١٢", "don't you'll 's 't", "1234567 89 0x0", "\x00 \x1c \x85 x", "x" * 3000, "中" * 500,
    " ́x á", "मानक हिन्दी", "!!! ??? ...", "A" * 40 + " " * 40 + "b", "﻿bom ﻿bom", "Ġ Ā", "ሴ x e y",
]


def alignment_rows(df) -> list[tuple]:
    return sorted(map(tuple, token_alignment.align(df, A_PATH, B_PATH).select(*COLUMNS).collect()), key=str)


def test_alignment_query(spark, sf_dir, local):
    got = sorted(map(tuple, Q.op13_token_alignment(spark, sf_dir).select(*COLUMNS).collect()), key=str)
    assert got == Plain().rows(local)


def test_alignment_awkward(spark, awkward):
    assert alignment_rows(awkward) == Plain().rows(awkward_texts())
    rows = [(i, t) for i, t in enumerate(HARD * 2)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Plain().rows(rows)
    assert alignment_rows(made) == want
    assert sum(r[1] == 0 for r in want) == 6  # the empty text and the two with a mark, each twice
    assert alignment_rows(made.limit(0)) == []


def test_alignment_groups_are_given_on_request(spark):
    made = spark.createDataFrame([(1, "tokenizers differ"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in token_alignment.align(made, A_PATH, B_PATH, with_groups=True).collect()}
    assert hashlib.sha256(rows[1]["groups"].encode()).hexdigest() == rows[1]["groups_sha256"]
    assert (rows[2]["groups"], rows[2]["n_a"]) == ("", 0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"ab", b"aa", b"ba", b"aab"]), max_size=12), st.integers(0, 10**6))
def test_transducer(words, seed):
    """Any two ways to cut the same bytes, and bytes that differ."""
    text, of = b"".join(words), dict(enumerate([b"a", b"b", b"ab", b"aa", b"ba", b"aab"]))

    def cut(seed: int) -> list[int]:
        out, at = [], 0
        while at < len(text):
            fits = [i for i, x in of.items() if text.startswith(x, at)]
            seed = (seed * 1103515245 + 12345) % 2**31
            out.append(fits[(seed >> 8) % len(fits)])
            at += len(of[out[-1]])
        return out

    a, b = cut(seed), cut(seed + 1)
    def align(*pairs):
        flat = lambda side: np.array([t for p in pairs for t in p[side]], np.int64)
        cuts = lambda side: np.cumsum([0, *(len(p[side]) for p in pairs)])
        return token_alignment.Transducer(of, of).align(flat(0), cuts(0), flat(1), cuts(1))

    agree, end_a, end_b, links, owners = align((a, b), (a, [*b, 0]), (a, b[:-1]), (b, a))
    assert agree.tolist() == [True, False, not text, True]
    n = len(a), len(b)
    groups = list(zip(np.split(a, np.flatnonzero(end_a[: n[0]]) + 1)[:-1], np.split(b, np.flatnonzero(end_b[: n[1]]) + 1)[:-1], strict=True))
    assert [i for g, _ in groups for i in g] == a
    assert [i for _, g in groups for i in g] == b
    assert all(b"".join(of[i] for i in x) == b"".join(of[i] for i in y) for x, y in groups)
    assert (owners == 0).sum() == (owners == 3).sum() == len(a) + len(b) - len(groups)
    assert sorted(links[owners == 0].tolist()) == sorted(((x & 0xFFFFFFFF) << 32) | x >> 32 for x in links[owners == 3].tolist())
