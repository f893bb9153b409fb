"""Fill-in-middle transformation: texts cut in units, a middle taken out and put at the end, by lookaround splitting.

A unit grammar is given as the classes of characters that meet at a boundary, and becomes a regular expression of no width:
what lies before (a lookbehind) and what lies after (a lookahead). Spark's ``split`` by it keeps every character, so the
pieces joined are the text. The empty text, of which ``split`` would make one empty piece, has no units and is handled apart.

Draws are the first four groups of eight hexadecimal digits of SHA-256(seed:doc_id), so that retries and engines agree. The
smaller and the greater of two draws modulo (units + 1) end the prefix and the middle. A text that contains a sentinel stays
plain: as each sentinel begins with a character that it does not contain again, the sentinels of an output are then the only
ones in it, and ``restored`` finds the text again from output and form alone.

Defined cases: null counts as the empty text and stays plain, with no units; a text of blanks alone is one unit; texts of any
length are cut whole, in one row; a null doc_id draws as the empty word does; repeated rows come out alike; an empty table
gives an empty result; columns beside doc_id and text, whatever their names, are not read by ``transformed``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common


class Grammar(NamedTuple):
    """Where units meet: the class of the last character of one and of the first of the next, as insides of brackets."""

    before: str
    after: str

    def boundary(self) -> str:
        return f"(?<=[{self.before}])(?=[{self.after}])"


BLANK, ANY = r"\x20\x09-\x0D", r"\s\S"
GRAMMARS = {
    "words": Grammar(f"^{BLANK}", BLANK),  # blanks go with the word that follows, those at the end are a unit
    "words_then_blanks": Grammar(BLANK, f"^{BLANK}"),  # blanks go with the word before
    "lines": Grammar(r"\n", ANY),
    "characters": Grammar(ANY, ANY),
}
#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def units(text: Column, grammar: Grammar) -> Column:
    """A text as an array of its units, which joined are the text; none for the empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary(), -1))


def transformed(docs: DataFrame, grammar: Grammar = GRAMMARS["words"], seed: int = 42, rate: int = 50, suffix_first: int = 80, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """Per row of docs: doc_id, n units, form (plain, psm or spm), prefix, middle, suffix (null where plain) and output.

    rate is the percentage of texts that are transformed, suffix_first that of them whose suffix comes first.
    """
    if any(not s or s[0] in s[1:] for s in sentinels) or len({s[0] for s in sentinels}) > 1 or len(set(sentinels)) < 3 or any(a != b and b.startswith(a) for a in sentinels for b in sentinels):
        raise ValueError("sentinels must begin alike, with a character they don't contain again, and none with another")
    p, s, m = map(F.lit, sentinels)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), drawn.alias("d"))
    draw = lambda i: F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("long")
    cut = base.select("doc_id", "t", units(F.col("t"), grammar).alias("u"), *[draw(i).alias(f"h{i + 1}") for i in range(4)])
    ends = F.array_sort(F.array(F.expr("h1 % (size(u) + 1)"), F.expr("h2 % (size(u) + 1)")))
    marked = F.contains("t", p) | F.contains("t", s) | F.contains("t", m)
    plain = (F.col("t") == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    placed = cut.select("doc_id", "t", "u", F.size("u").cast("long").alias("n"), form.alias("form"), ends[0].cast("int").alias("a"), ends[1].cast("int").alias("b"))
    piece = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("u", start, length), ""))
    a, b = F.col("a"), F.col("b")
    parts = placed.select("doc_id", "t", "n", "form", piece(F.lit(1), a).alias("prefix"), piece(a + 1, b - a).alias("middle"), piece(b + 1, F.size("u") - b).alias("suffix"))
    psm = F.concat(p, "prefix", s, "suffix", m, "middle")
    spm = F.concat(s, "suffix", p, "prefix", m, "middle")
    out = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("t"))
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", out.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that output and form were made of."""
    p, s, m = sentinels
    first, second = F.when(form == "psm", F.lit(p)).otherwise(F.lit(s)), F.when(form == "psm", F.lit(s)).otherwise(F.lit(p))
    at = lambda mark: F.locate(mark, output)
    place = F.when(form == "psm", at(s)).otherwise(at(p))
    one = F.substring(output, F.length(first) + 1, place - F.length(first) - 1)
    two = F.substring(output, place + F.length(second), at(m) - place - F.length(second))
    three = F.substring(output, at(m) + len(m), F.length(output))
    whole = F.when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))
    return F.when(form == "plain", output).otherwise(whole)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transformed(common.table(spark, sf_dir, "documents"))
    back = F.sha2(restored(F.col("output"), F.col("form")), 256)
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    return found.select("doc_id", "n", "form", chars("prefix"), chars("middle"), F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM d),
e AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
