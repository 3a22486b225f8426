"""Small inputs with the awkward cases every operator must survive."""

from __future__ import annotations

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
NEAR = BASE.replace("mu", "nu")


def rows():
    """NULL and empty texts, NULL id, copies, a repeated row, a long text."""
    long_text = " ".join(f"word{i % 997} tail{i}" for i in range(6000))
    texts = {
        1: BASE, 2: BASE, 3: NEAR, 4: None, 5: "", 6: " \t\n", 7: "One Word",
        8: "single", 9: long_text, 10: f"{BASE}\n{NEAR}\n\nunder the MIT License.\n{BASE}",
        11: "Apache License, version 2; CC-BY-NC " * 3, 12: "naïve café 中文 🙂 <|endoftext|>",
    }
    out = [(i, t, "en", "src0", len(t or "")) for i, t in texts.items()]
    out.append((8, "single", "en", "src1", 6))
    out.append((None, "no id here", None, None, None))
    return out


def frame(spark, data=None, extra=True):
    """The rows as a table, with extra columns whose names operators also use."""
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
    if extra:
        for name in ("kept", "keep_id", "fp", "key", "start", "length", "score", "ids", "slice"):
            df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(row):
    return row[1] or ""
