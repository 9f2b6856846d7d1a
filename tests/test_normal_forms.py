"""Normal forms and character references against the standard library, for every code point and every name."""

import html
import random
import unicodedata
from html.entities import html5

from pyspark.sql import functions as F

from agendula.functions import text as T


def _points():
    return [chr(n) for n in range(1, 0x110000) if not 0xD800 <= n <= 0xDFFF]


def _bare(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def _apply(spark, texts, f, chunk=64):
    """f over texts, several of them a row, parted by a line break."""
    rows = [(i, "\n".join(texts[i : i + chunk])) for i in range(0, len(texts), chunk)]
    got = spark.createDataFrame(rows, "i int, t string").repartition(8).select("i", f(F.col("t")).alias("t")).collect()
    return {r.i: r.t for r in got}, dict(rows)


def test_every_code_point_loses_its_marks(spark):
    got, rows = _apply(spark, [f"a{c}b" for c in _points() if c not in "\n"], T.strip_accents, 512)
    assert [i for i in rows if got[i] != _bare(rows[i])] == []


def test_every_code_point_in_compatibility_form(spark):
    got, rows = _apply(spark, [f"a{c}|" for c in _points() if c != "\n" and not unicodedata.combining(c) and len(unicodedata.normalize("NFKC", f"a{c}")) == 1 + len(unicodedata.normalize("NFKC", c))], T.nfkc, 512)
    assert [i for i in rows if got[i] != "\n".join(unicodedata.normalize("NFKC", t[1:-1]).join(("a", "|")) for t in rows[i].split("\n"))] == []


def test_every_name(spark):
    texts = [f"x&{k}{tail}y" for k in html5 for tail in ("", " ", ";", "it;")] + ["caf&eacute", "&copy 2024", "&NotEqualTilde;", "&notit;", "&unknown;", "&;", "&", "&&amp;&", "a&b=c&d", "&amp;lt;", "&AMP", "&ampersand;"]
    got, rows = _apply(spark, texts, T.unescape)
    assert [i for i in rows if got[i] != html.unescape(rows[i])] == []


def test_numbers(spark):
    numbers = [*range(0, 400), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1FFFE, 0x10FFFF, 0x110000, 10**8, 10**12, 10**30]
    texts = [f"x&#{p}{z}{n:{k}}{end}y" for n in numbers for p, k in (("", "d"), ("x", "x"), ("X", "X")) for z, end in (("", ";"), ("000", ""))] + ["&#;", "&#x;", "&#xg;"]
    got, rows = _apply(spark, [t for t in texts if html.unescape(t) != ""], T.unescape, 1)
    assert [(rows[i], got[i]) for i in rows if got[i] != html.unescape(rows[i])] == []


def test_mixed_texts(spark):
    r = random.Random(1)
    pool = [*"abé ", "ﬁ", "ﷺ", "한", "각", "ำ", "ǆ", "ŉ", "ẚ", "①", "㎏", "é", "漢", "豈", "𝐀"]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(30))) for _ in range(300)] + [""]
    got, rows = _apply(spark, texts, T.strip_accents, 1)
    assert [rows[i] for i in rows if got[i] != _bare(rows[i])] == []
    assert spark.range(1).select(T.strip_accents(F.lit(None).cast("string")).alias("t"), T.unescape(F.lit(None).cast("string")).alias("u")).first() == (None, None)
