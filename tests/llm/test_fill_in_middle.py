import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessella.llm import fill_in_middle as f

UNITS = {
    "words": re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"),
    "words_then_blanks": re.compile(r"^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"),
    "lines": re.compile(r"[^\n]*\n|[^\n]+"),
    "characters": re.compile(r"[\s\S]"),
}
TEXTS = [None, "", " ", "\n\n", "a", " a", "a ", "a  b\tc\n\nd  ", "<P> in it", "it<M>", "<S", "< P><", "S>a <", "P>b", "<<M", "😀 é 😀b   c d", "日本 語\x0b\x0cz", "a<b <", "x\r\ny\rz", "tail\n"] + [f"w{i} " * (i % 9 + 1) for i in range(60)] + ["long word " * 60_000]


def brute(i, text, units, rate=50, first=80):
    t = text or ""
    d = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = units.findall(t)
    assert "".join(u) == t
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, t
    if h[3] % 100 < first:
        return len(u), "spm", pre, mid, f"<S>{suf}<P>{pre}<M>{mid}"
    return len(u), "psm", pre, mid, f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("grammar", sorted(UNITS))
def test_against_brute_force(spark, grammar):
    rows = [(i, t, "x", -1) for i, t in enumerate(TEXTS)] + [(None, "a b c d", "x", 0), (7, TEXTS[7], "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, u string, n int")
    found = f.transformed(docs, f.GRAMMARS[grammar], rate=80).withColumn("back", f.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((x.doc_id, x.n, x.form, x.prefix, x.middle, x.output) for x in found), key=str)
    assert got == sorted(((i, *brute(i, t, UNITS[grammar], 80)) for i, t, *_ in rows), key=str)
    assert sorted(x.back for x in found) == sorted(t or "" for _, t, *_ in rows)
    assert {x.form for x in found} == {"plain", "psm", "spm"}


def test_sentinels_across_pieces_are_not_mistaken(spark):
    """Texts whose pieces, put beside sentinels, come close to sentinels."""
    rows = [(i, t) for i, t in enumerate(["< P> <S > <", "P> < <P <M", "<S <P <M", "> S> P>", "<< <<M <<"] * 40)]
    found = f.transformed(spark.createDataFrame(rows, "doc_id long, text string"), rate=100, suffix_first=50).withColumn("back", f.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((x.doc_id, x.back) for x in found) == rows and {x.form for x in found} == {"psm", "spm"}


@pytest.mark.parametrize("bad", [("<P>", "<S>", "<P>"), ("<P", "<P>", "<M>"), ("", "<S>", "<M>"), ("<<P", "<S>", "<M>"), ("[P]", "<S>", "<M>")])
def test_unusable_sentinels_are_refused(spark, bad):
    with pytest.raises(ValueError):
        f.transformed(spark.createDataFrame([], "doc_id long, text string"), sentinels=bad)


def test_empty_table(spark):
    assert f.transformed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
