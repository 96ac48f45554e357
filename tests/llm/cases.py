"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, key string, doc string, label int"
LINE = "this line is long enough to be a key"
PASSAGE = " ".join(f"w{k}" for k in range(60))


def rows() -> list[tuple]:
    rng = random.Random(7)
    words = ["alpha", "beta,", "Gamma", "délta", "naïve", "don't", "x1", "###", "&", "of", "the", "zeta."]

    def prose(n: int) -> str:
        return " ".join(rng.choice(words) + str(rng.randrange(50)) * (rng.random() < 0.5) for _ in range(n))

    base = prose(120)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [None, "", " ", "\n", "\n\n", "one", "one two", "a " * 100, "a b c " * 40, base, base, near, base.upper(), prose(3000), "x" * 5000, f"{LINE}\n{prose(30)}", f"{prose(30)}\n  {LINE.upper()} \t", f"{LINE}\n{LINE}\nother", f"{LINE}", f"{PASSAGE} {prose(20)}", f"{prose(20)}\n{PASSAGE}", f"{PASSAGE[20:200]} tail", "   leading   spaces \n\n\n and <|endoftext|> marks", "Licensed under the Apache License.\nSPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause", "cc by cc by apache license mit  license", "ünï ¿ 你好 привет 12 !!"]
    out = [(k, t, "en" if k % 3 else None, "src0", len(t or ""), True, 0.5, "k", "d", k) for k, t in enumerate(texts)]
    out.append(out[9])  # a repeated row
    out.append((None, base, "en", None, None, None, None, None, None, None))
    return out


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def unique(spark: SparkSession) -> DataFrame:
    """Without the repeated row and the row without an id."""
    return documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
