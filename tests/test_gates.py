"""The readings that gates share hold what the layers look for, and little else."""

from pyspark.sql import functions as F

from veil.functions.normalize import LOOKALIKE, fold_lookalikes, normalize, strip_invisible
from veil.operators import detect as d

VALUES = ["4111 1111 1111 1111", "234567890124", "ABCDE1234F", "HDFC0123456", "+1 20 30 40", "20 (212) 555-1234",
          "212.555.1234", "98765-43210", "192.168.1.1", "12.345, 77.123", "cvv 123", "otp 1234", "i am 33 years old",
          "H.No 5, Sector 5", "account number 123456", "12345678901", "1234567890123456789", "roll no. a1234",
          "aGVsbG8gd29ybGQ=cGFzc3dvcmQ9aHVudGVyMjE=", "70617373776f72643d68756e74657232", "Xk9_-+/=zz81hhGGtt55rr"]
PROSE = "every summer the people of the old town walk slowly down to the river, and nobody asks why. " * 50


def test_shared_readings_change_no_layer(spark):
    texts = [(a + v + b,) for v in VALUES for a in ("", "x", " ", "abcdefghijklmnopqrst ", "a1 (") for b in ("", ") ", "-z", " é ok")]
    texts += [(v + " and " + w,) for v in VALUES for w in VALUES]
    rows = spark.createDataFrame(texts, "text string")
    alone = "concat(" + ", ".join(layer("text") for layer in d.LAYERS.values()) + ")"
    # Without shared readings the gates of digits read the text itself.
    got = rows.select("text", F.expr(alone).alias("alone"), F.expr(d.all_items("text")).alias("shared")).collect()
    assert sum(len(r.alone) for r in got) > len(VALUES)
    assert [r.text for r in got if r.alone != r.shared] == []


def test_gates_read_little_of_prose(spark):
    row = spark.createDataFrame([(PROSE,)], "text string").select(
        F.expr(f"length({d.long_runs('text')})"), F.expr(f"length({d.near_digits('text')})")).first()
    assert max(row) <= 2


def test_every_odd_character_is_still_folded(spark):
    odd = [(f"a{c}b",) for c in LOOKALIKE + "­᠎​‏‪‮⁠⁤﻿’é漢"]
    rows = spark.createDataFrame(odd, "text string").select(
        F.expr(normalize("text")).alias("got"), F.expr(fold_lookalikes(strip_invisible("text"))).alias("want"))
    assert [r for r in rows.collect() if r.got != r.want] == []
