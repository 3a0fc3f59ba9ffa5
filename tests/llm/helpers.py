"""Brute-force versions of the contracts, and small tables with awkward rows."""

import re
import zlib

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows(name="documents", folder=SF):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


#: Nulls, empty and white-space texts, ties, repeated rows, special strings, odd white space, one long text.
AWKWARD = [
    (5, "plain words go here", "en"), (5, "plain words go here", "en"), (None, None, None), (None, "no key but words", "en"),
    (7, None, "de"), (8, "", None), (9, " \t \n ", "fr"), (10, "x<|endoftext|>y  two  spaces\n\n\ttab\r\nline ", "en"),
    (11, "One line.\nOne line.\nAnother line that is long enough.\n  One line.  ", "es"), (12, "ñandú 漢字 テスト — don't we'll 123,4", "es"),
    (13, "lorem " * 4000, "en"), (14, "z" * 9000, "en"), (15, "\x00 \x01 \x1c \u0085 　 ▁ ▁▁ a", None), (-3, "negative key", "en"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, block long, tile string, `__row` int"


def awkward(spark, data=AWKWARD):
    return spark.createDataFrame([(i, t, lang, "s", None, "f", 1, "t", 2) for i, t, lang in data], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
