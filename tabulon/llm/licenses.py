"""License scans with DataFrame functions only: TF-IDF cosine of notices to templates, then inheritance from directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import cut

# Notices by which the licences are usually stated (SPDX name, text)
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("ISC", "Released under the ISC License"),
]
# a sentence can be a notice only if it holds one of these
SIGNAL = r"(?i)licen[sc]e|permission is hereby granted|redistribution and use|public domain|spdx-license-identifier"
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"
SENTENCES = r"\n|(?<=[.!?])\s+"
WORDS = r"[^a-z0-9]+"


def terms(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower case."""
    return F.filter(F.split(F.lower(text), WORDS), lambda w: w != "")


def directory(path: Column) -> Column:
    """Everything before the last slash, without it; empty at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(path: Column) -> Column:
    """The directory itself and all above it, up to the top (the empty name)."""
    parts = F.split(path, "/")
    return F.when(path == "", F.array(F.lit(""))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    )


def template_weights(files: DataFrame) -> DataFrame:
    """``template, license, term, tf, idf``: template terms with their frequencies over all files (bounded by the templates)."""
    spark = files.sparkSession
    rows = [(i, name, text) for i, (name, text) in enumerate(TEMPLATES)]
    templates = spark.createDataFrame(rows, "template int, license string, notice string")
    vocabulary = templates.select(F.explode(terms(F.col("notice"))).alias("term")).distinct()
    words = [r[0] for r in vocabulary.collect()]  # some hundred
    known = F.array(*[F.lit(w) for w in sorted(words)])
    total = files.count()
    counted = files.select(F.explode(F.array_intersect(known, terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((1.0 + F.lit(float(total))) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0
    spread = templates.select("template", "license", F.explode(terms(F.col("notice"))).alias("term")).groupBy("template", "license", "term").agg(
        F.count(F.lit(1)).alias("tf"))
    return cut(spread.join(counted, "term", "left").select("template", "license", "term", "tf", idf.alias("idf"), F.lit(float(total)).alias("files")))


def scan_licenses(files: DataFrame, least: float = 0.7) -> DataFrame:
    """``path, license, cosine, origin, license_dir`` for every row of ``files`` (``path, text``).

    Sentences that may be notices (``SIGNAL``) are compared with the templates by the cosine of their TF-IDF vectors;
    frequencies count all files.  A file's own licence is the most similar template of its sentences, if the cosine
    reaches ``least`` (ties: licence name); ``origin`` is then "notice".  A directory has the licence of the licence
    files in it (by name, ``LICENSE_FILE``), the most similar of several.  Other files inherit ("inherited",
    ``license_dir``) from the nearest directory above them that has one; ``license`` is null if there is none.

    Null or empty text has no notice but may inherit; a null path has no directory and inherits nothing; repeated paths
    are judged together (their sentences count as one file's) and returned for each row; an empty table gives no rows.
    """
    rows = files.select("path", "text")
    weights = template_weights(rows)
    lengths = weights.groupBy("template").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("template_norm"))
    by_term = F.broadcast(weights.groupBy("term").agg(F.first("idf").alias("idf")))
    sentence = F.posexplode(F.filter(F.split("text", SENTENCES), lambda s: s.rlike(SIGNAL))).alias("at", "sentence")
    notices = rows.filter(F.col("text").rlike(SIGNAL)).select("path", F.xxhash64("text").alias("body"), sentence)
    counted = notices.select("path", "body", "at", F.explode(terms(F.col("sentence"))).alias("term")).groupBy("path", "body", "at", "term").agg(F.count(F.lit(1)).alias("n"))
    rare = weights.agg(F.log(1.0 + F.max("files")) + 1.0).first()[0]
    weighed = counted.join(by_term, "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(rare if rare else 1.0)))
    key = ["path", "body", "at"]
    norms = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(weights.select("template", "license", "term", (F.col("tf") * F.col("idf")).alias("tw"))), "term").groupBy(*key, "template", "license").agg(
        F.sum(F.col("w") * F.col("tw")).alias("dot"))
    same = [norms[c].eqNullSafe(dots[c]) for c in key]
    similar = dots.join(norms, same).join(F.broadcast(lengths), "template").select(
        dots["path"], "license", F.round(F.col("dot") / (F.col("norm") * F.col("template_norm")), 6).alias("cosine")
    ).filter(F.col("cosine") >= least)
    # one row per path and licence first, so that what is compared per path is bounded by the templates
    per_license = similar.groupBy("path", "license").agg(F.max("cosine").alias("cosine"))
    nth = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("cosine"), "license"))
    own = cut(per_license.withColumn("nth", nth).filter("nth = 1").drop("nth"))
    in_dir = own.filter(F.col("path").rlike(LICENSE_FILE)).withColumn("dir", directory(F.col("path")))
    per_dir = in_dir.groupBy("dir", "license").agg(F.max("cosine").alias("cosine"))
    first = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("cosine"), "license"))
    dir_licenses = per_dir.withColumn("nth", first).filter("nth = 1").select(
        F.col("dir").alias("license_dir"), F.col("license").alias("dir_license"), F.col("cosine").alias("dir_cosine"))
    dirs = rows.filter("path is not null").select(directory(F.col("path")).alias("dir")).distinct()
    above = dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias("license_dir"))
    depth = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc(F.length("license_dir"))))
    nearest = above.join(dir_licenses, "license_dir").withColumn("nth", depth).filter("nth = 1").drop("nth")
    reserved = ("license", "cosine", "origin", "license_dir", "dir", "dir_license", "dir_cosine")
    keep = [c for c in files.columns if c != "text" and c not in reserved]
    placed = files.select(*keep, directory(F.col("path")).alias("dir")).join(own.select("path", "license", "cosine"), "path", "left").join(nearest, "dir", "left")
    has = F.col("license").isNotNull()
    return placed.select(
        *keep,
        F.coalesce("license", "dir_license").alias("license"),
        F.when(has, F.col("cosine")).otherwise(F.col("dir_cosine")).alias("cosine"),
        F.when(has, "notice").when(F.col("dir_license").isNotNull(), "inherited").alias("origin"),
        F.when(~has, F.col("license_dir")).alias("license_dir"),
    )
