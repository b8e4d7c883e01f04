"""Cleaned texts beside the patterns applied one after the other to every text."""

import re

from pyspark.sql import functions as F

from usagelens.functions.text import clean_user_text

TEXTS = ["", "plain  text\n", "see HTTPS://x.example/a?b and mail A.b+c@d-e.example now", "key sk-" + "a" * 20 + " AKIA" + "B" * 16 + " ghp_" + "c" * 20, "sk-short",
         "http:// alone", "a@b", "https://u@mail.example", "x\0@y.example", "no\x1c\x85literal", "ftp://u:p@h.example sk-" + "9" * 30]


def plain(text):
    text = re.sub(r"(?i)https?://\S+", "[REDACTED_URL]", text.replace("\0", ""))
    text = re.sub(r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[REDACTED_EMAIL]", text)
    text = re.sub(r"\b(sk-[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{20,})\b", "[REDACTED_SECRET]", text)
    return re.sub(r"[\s\x1c-\x1f]+", " ", text).strip(" ")


def test_gates_change_no_result(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string")
    got = frame.select("t", clean_user_text(F.col("t")).alias("c"))
    assert [r.c for r in got.collect()] == [plain(t) for t in TEXTS] + [None]


def test_patterns_stand_behind_their_literals(spark):
    """Each search is in a branch that texts without its literals do not take."""
    expression = str(clean_user_text(F.col("t")))
    assert expression.count("CASE WHEN") >= 3 and all("contains(" in expression and x in expression for x in ("://", "@", "ghp_"))
