"""License scans: sparse TF-IDF cosine to templates, then inheritance by path.

Header sentences (those that speak of a licence, copyright or rights) become
sparse term vectors, and licence files by such sentences as well as whole;
templates are whole licence texts and the phrases that name or grant a licence.
Inverse document frequencies count all distinct headers and templates.  A vector
takes the template of the highest cosine, if that reaches ``least`` for phrases
and ``least_whole`` for whole texts: long legal texts resemble each other, and
one that is none of the templates has no licence here.  Where a text's title
names the Affero licence, only that one can match.  Reserved rights count only
where no licence matches.  A document without a licence of its own
inherits that of the nearest directory, its own or an ancestor, that holds a
licence file.

Distinct headers and distinct directories are matched once each, however often
they are repeated.  Null texts have no header; null paths inherit nothing; of
several licence files in a directory the best cosine counts, then the smallest
name; of templates equally near a text, the smallest name.  Repeated rows are
matched alike.  An empty table gives an empty result.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import hot_join, materialize

#: Names of licences and phrases by which texts grant them.
TEMPLATES = (
    ("MIT", "released under the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software to deal in the software without restriction"),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-2.0", "this work is licensed under the gnu general public license version 2"),
    ("LGPL-3.0", "licensed under the gnu lesser general public license version 3"),
    ("AGPL-3.0", "licensed under the gnu affero general public license version 3"),
    ("MPL-2.0", "subject to the terms of the mozilla public license version 2.0"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms with or without modification are permitted bsd license"),
    ("CC-BY-4.0", "licensed under cc by 4.0"),
    ("CC-BY-SA-4.0", "licensed under cc by-sa 4.0"),
    ("CC-BY-NC-4.0", "licensed under cc by-nc 4.0"),
    ("CC-BY-4.0", "licensed under cc by 4.0 creative commons attribution"),
    ("CC-BY-SA-4.0", "licensed under cc by-sa 4.0 creative commons attribution sharealike"),
    ("CC-BY-NC-4.0", "licensed under cc by-nc 4.0 creative commons attribution noncommercial"),
    ("CC0-1.0", "dedicated to the public domain cc0 1.0"),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007"),
    ("GPL-2.0", "gnu general public license version 2 june 1991"),
    ("LGPL-3.0", "gnu lesser general public license version 3 29 june 2007"),
    ("AGPL-3.0", "gnu affero general public license version 3 19 november 2007"),
    ("MPL-2.0", "mozilla public license version 2.0"),
    ("Apache-2.0", "apache license version 2.0 january 2004"),
    ("Proprietary", "all rights reserved"),
    ("Proprietary", "copyright all rights reserved"),
)
#: Whole licence texts: files <name>.txt beside this module.
WHOLE = tuple((f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))
#: The Affero licence is worded as version 3 of the general one, but for its name.
AFFERO = "AGPL-3.0"
WHOLE += tuple((AFFERO, text.replace("GNU GENERAL", "GNU AFFERO GENERAL").replace("GNU General", "GNU Affero General")) for name, text in WHOLE if name == "GPL-3.0")
_AFFERO_TITLE = r"(?is)^.{0,200}affero general public license"
#: Least cosines with phrases and with whole texts.
LEAST, LEAST_WHOLE = 0.55, 0.9
_CUES = ("licens", "licenc", "copyright", "all rights reserved", "public domain", "redistribution", "permission is")
#: A sentence that grants a licence, at the start of a line or after another.
_GRANT = r"(?im)(?:^|[.!?;][ \t])[^a-z\n]*+(?:(?:this work is )?(?:licensed|released) under|permission is hereby granted|redistribution and use|subject to the terms of|dedicated to the public domain)"
_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"


def _has_cue(text: Column) -> Column:
    low = F.lower(text)
    found = low.contains(_CUES[0])
    for cue in _CUES[1:]:
        found = found | low.contains(cue)
    return found


def grants(text: Column) -> Column:
    """Whether any line of a text grants a licence."""
    return F.coalesce(_has_cue(text) & text.rlike(_GRANT), F.lit(False))


def _terms(text: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9.+-]+", " "), " ")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^[.-]+|[.-]+$", "")), lambda w: w != "")


def match_templates(texts: DataFrame, least: float = LEAST, least_whole: float = LEAST_WHOLE) -> DataFrame:
    """(tid, license, cosine) for those of ``texts`` (tid, text; distinct) that
    are near a template."""
    spark = texts.sparkSession
    rows = [(f"{i}", name, phrase, i >= len(TEMPLATES)) for i, (name, phrase) in enumerate(TEMPLATES + WHOLE)]
    known = spark.createDataFrame(rows, "template string, license string, phrase string, whole boolean")
    template = known.select("template", "license", "whole", F.explode(_terms(F.col("phrase"))).alias("term")).groupBy("template", "license", "whole", "term").agg(F.count("*").alias("tf"))
    seen = texts.select("tid", F.explode(_terms(F.col("text"))).alias("term")).groupBy("tid", "term").agg(F.count("*").alias("tf"))
    seen = materialize(seen, "terms")
    total = texts.count() + len(rows)
    spread = seen.select("term").unionByName(template.select("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = materialize(spread.select("term", (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1).alias("idf")), "idf")

    def weighed(vectors: DataFrame) -> DataFrame:
        return vectors.join(idf, "term").withColumn("weight", F.col("tf") * F.col("idf"))

    t = weighed(template)
    t = t.join(t.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("length")), "template")
    t = t.select("template", "license", "whole", "term", (F.col("weight") / F.col("length")).alias("part"))  # a row for each template term
    h = weighed(seen)
    lengths = h.groupBy("tid").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("length"))
    cosine = h.join(F.broadcast(t), "term").groupBy("tid", "template", "license", "whole").agg(F.sum(F.col("weight") * F.col("part")).alias("dot"))
    cosine = cosine.join(lengths, "tid").withColumn("cosine", F.round(F.col("dot") / F.col("length"), 9)).filter(F.col("cosine") >= F.when(F.col("whole"), least_whole).otherwise(least))
    affero = texts.filter(F.col("text").rlike(_AFFERO_TITLE)).select("tid", F.lit(True).alias("affero"))
    cosine = cosine.join(affero, "tid", "left").filter(F.col("affero").isNull() | (F.col("license") == AFFERO))
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "license"))
    return cosine.groupBy("tid").agg(best.alias("best")).select("tid", F.col("best.license").alias("license"), (-F.col("best.c")).alias("cosine"))


def ancestors(directory: Column) -> Column:
    """The directory and all above it, as an array of (ancestor, depth)."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("ancestor"), i.alias("depth")))


def inherit(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """(directory, license, license_dir): for distinct ``directories``, the
    licence of the nearest of ``licensed`` (directory, license) at or above."""
    up = directories.select("directory", F.explode(ancestors(F.col("directory"))).alias("a")).select("directory", F.col("a.ancestor").alias("license_dir"), F.col("a.depth").alias("depth"))
    met = up.join(licensed.withColumnRenamed("directory", "license_dir"), "license_dir")
    return met.groupBy("directory").agg(F.max_by(F.struct("license", "license_dir"), "depth").alias("near")).select("directory", F.col("near.license").alias("license"), F.col("near.license_dir").alias("license_dir"))


def _preference() -> Column:
    """Licences before reserved rights, then by cosine, then by name."""
    return F.struct((F.col("license") == "Proprietary").alias("reserved"), (-F.col("cosine")).alias("c"), "license")


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, least_whole: float = LEAST_WHOLE) -> DataFrame:
    """(doc_id, path, license, cosine, license_from): ``license_from`` is
    ``header``, ``file`` or the directory that the licence is inherited from."""
    text = F.col(text_col)
    # by line, and again with wrapped lines (and their comment marks) joined
    unwrapped = F.regexp_replace(text, r"(?<![.!?;:\n])\n[ \t]*(?:#+|//+|\*+|--+|;+)?[ \t]*(?=\S)", " ")
    sentences = F.filter(F.concat(*[F.split(t, r"\n|(?<=[.!?;])[ \t]+") for t in (text, unwrapped)]), lambda s: _has_cue(s))
    is_file = F.coalesce(path.rlike(_FILE), F.lit(False))
    spoken = F.when(is_file, F.array_distinct(F.concat(F.array(text), sentences))).when(_has_cue(text), F.array_distinct(sentences))
    rows = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), is_file.alias("is_file"), F.coalesce(spoken, F.expr("cast(array() as array<string>)")).alias("spoken"), F.monotonically_increasing_id().alias("rid"))
    rows = materialize(rows.withColumn("directory", F.regexp_replace("path", r"/?[^/]*$", "")), "headers")
    said = rows.select("rid", "doc_id", "directory", "is_file", F.explode("spoken").alias("text")).filter(F.col("text").isNotNull()).withColumn("tid", F.md5("text"))
    matched = materialize(match_templates(said.select("tid", "text").dropDuplicates(["tid"]), least, least_whole), "matched")
    # a common header is matched once and met by all its rows
    times = said.groupBy("tid").agg(F.count("*").alias("times"))
    said_as = hot_join(said.select("rid", "tid"), matched.join(times, "tid"), "tid", "times")
    own = said_as.groupBy("rid").agg(F.min(_preference()).alias("best"))
    own = materialize(rows.drop("spoken").join(own, "rid", "left").select("doc_id", "path", "directory", "is_file", F.col("best.license").alias("license"), (-F.col("best.c")).alias("cosine")), "own")
    files = own.filter(F.col("is_file") & F.col("license").isNotNull() & F.col("directory").isNotNull())
    files = files.groupBy("directory").agg(F.min(_preference()).alias("best")).select("directory", F.col("best.license").alias("license"))
    open_ = own.filter(F.col("license").isNull() & F.col("directory").isNotNull()).groupBy("directory").agg(F.count("*").alias("rows"))
    near = inherit(open_.select("directory"), files).withColumnRenamed("license", "inherited").join(open_, "directory")
    out = hot_join(own, near, "directory", "rows", "left")
    source = F.when(F.col("license").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).otherwise(F.col("license_dir"))
    return out.select("doc_id", "path", F.coalesce("license", "inherited").alias("license"), "cosine", source.alias("license_from"))
