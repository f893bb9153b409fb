"""Items built from texts: gates, blanks, keys, rendered options, grids of cases, slices, exclusions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import screen
from tessella.plans.registry import query, spread, table

MD5 = lambda *c: F.md5(F.concat_ws(":", *c))


@query("""WITH g AS (SELECT p_brand, p_type, list(p_name ORDER BY p_partkey) AS choices, list(p_retailprice ORDER BY p_partkey) AS prices FROM part GROUP BY 1, 2)
SELECT p_brand, p_type, list_position(prices, list_max(prices))::INTEGER - 1 AS answer, CASE WHEN len(choices) <> 4 THEN 'choices' WHEN len(list_filter(choices, lambda c: trim(c) = '')) > 0 THEN 'blank' WHEN len(list_distinct(choices)) < 4 THEN 'repeated' WHEN p_type IN (SELECT p_type FROM part WHERE p_size = 1) THEN 'banned' ELSE 'kept' END AS reason FROM g""")
def gated_items(spark, sf_dir):
    """Items of all their options: why one goes that has not exactly four, a blank or a repeated one, or a question that is
    banned; and the place of the answer."""
    part = table(spark, sf_dir, "part")
    each = part.groupBy("p_brand", "p_type").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name", "p_retailprice"))).alias("t"))
    items = each.select("p_brand", "p_type", F.col("t.p_name").alias("choices"), F.col("t.p_retailprice").alias("prices"))
    banned = part.where("p_size = 1").select("p_type", F.lit(True).alias("banned")).distinct()
    rules = [("choices", F.size("choices") != 4), ("blank", F.exists("choices", lambda c: F.trim(c) == "")), ("repeated", F.size(F.array_distinct("choices")) < 4), ("banned", F.col("banned"))]
    answer = (F.array_position("prices", F.array_max("prices")) - 1).cast("int").alias("answer")
    return items.join(banned, "p_type", "left").select("p_brand", "p_type", answer, screen.first_reason(rules).alias("reason"))


@query(r"""SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND trim(text) <> '' AND right(trim(text), 1) IN ('.', '!', '?')""")
def natural_endings(spark, sf_dir):
    """Replies that end by themselves: not empty, and closed by an end of sentence."""
    t = F.trim("text")
    return table(spark, sf_dir, "conversations").where((F.col("role") == "assistant") & (t != "") & F.right(t, F.lit(1)).isin(".", "!", "?")).select("conv_id", "turn")


@query("""WITH r AS (SELECT conv_id, turn, md5(concat_ws(':', 'one', conv_id, turn)) AS h, row_number() OVER (PARTITION BY conv_id ORDER BY md5(concat_ws(':', 'one', conv_id, turn))) AS k FROM conversations)
SELECT conv_id, turn FROM r WHERE k = 1 ORDER BY h, conv_id LIMIT 200""")
def one_per_sequence(spark, sf_dir):
    """At most one turn of each conversation, in hash order, until 200 are found."""
    h = MD5(F.lit("one"), "conv_id", "turn")
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min(F.struct(h.alias("h"), "turn")).alias("t"))
    return first.orderBy("t.h", "conv_id").limit(200).select("conv_id", "t.turn")


@query(r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(s)::INTEGER AS n, md5(array_to_string(s, '|')) AS digest FROM s""")
def sentence_split(spark, sf_dir):
    s = T.sentences("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


_SENTENCES = r"string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1))"


@query(rf"""
WITH p AS (SELECT doc_id, text, {_SENTENCES} AS s FROM documents WHERE len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) BETWEEN 80 AND 200),
w AS (SELECT doc_id, i, unnest(regexp_extract_all(s[i], '[A-Za-z]+')) AS w, len(list_filter(string_split_regex(s[i], '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS n FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM p)),
c AS (SELECT doc_id, lower(w) AS l, count(*) AS c FROM w GROUP BY ALL),
u AS (SELECT w.doc_id, i, w.w, n, md5(concat_ws(':', w.doc_id, w.w)) AS h FROM w JOIN c ON c.doc_id = w.doc_id AND c.l = lower(w.w) AND c = 1 WHERE length(w.w) >= 6),
t AS (SELECT doc_id, arg_min((w, i), h) AS x FROM u WHERE n >= 12 GROUP BY doc_id),
d AS (SELECT u.doc_id, list(w ORDER BY h)[1:3] AS d FROM u JOIN t USING (doc_id) WHERE u.i <> x[2] GROUP BY 1 HAVING count(*) >= 3)
SELECT doc_id, x[1] AS target, md5(replace(s[x[2]], x[1], '____')) AS sentence, array_to_string(d, ' ') AS distractors FROM t JOIN d USING (doc_id) JOIN p USING (doc_id)""")
def blank_items(spark, sf_dir):
    """Fill-in-the-blank items of passages of 80 to 200 words: a word of six letters or more that occurs once, taken out of a
    sentence of twelve words or more; three such words of other sentences are the distractors. Hashes choose."""
    size = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    docs = table(spark, sf_dir, "documents").where(size("text").between(80, 200)).select("doc_id", T.sentences("text").alias("s"))
    each = docs.select("doc_id", F.posexplode("s").alias("i", "sentence"))
    words = each.select("doc_id", "i", size("sentence").alias("n"), F.explode(F.regexp_extract_all("sentence", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    once = words.groupBy("doc_id", F.lower("w").alias("l")).agg(F.count(F.lit(1)).alias("c"), F.first("w").alias("w"), F.first("i").alias("i"), F.first("n").alias("n")).where("c = 1 AND length(w) >= 6")
    once = once.select("doc_id", F.struct(MD5("doc_id", "w").alias("h"), "w", "i", "n").alias("x"))
    of = once.groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("x")).withColumn("t", F.get(F.filter("x", lambda x: x["n"] >= 12), F.lit(0))).where("t IS NOT NULL")
    found = of.select("doc_id", "t", F.filter("x", lambda x: x["i"] != F.col("t")["i"]).alias("d")).where("size(d) >= 3").join(docs, "doc_id")
    return found.select("doc_id", F.col("t.w").alias("target"), F.md5(F.replace(F.get("s", F.col("t.i")), F.col("t.w"), F.lit("____"))).alias("sentence"), F.array_join(F.slice("d", 1, 3)["w"], " ").alias("distractors"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS words, regexp_replace(regexp_replace(lower(p_name || '.txt'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS stem, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS squashed,
 regexp_replace(trim(regexp_replace(lower(regexp_extract('The ' || p_type || ': ' || p_name, '^[^;:]*')), '[^a-z0-9]+', ' ', 'g')), '^(the|a|an) ', '') AS core FROM part""")
def title_keys(spark, sf_dir):
    """Words, stem, squashed form and core of titles."""
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.letters_and_digits(name).alias("words"), T.letters_and_digits(F.concat(name, F.lit(".txt")), "_").alias("stem"), T.letters_and_digits(name, "").alias("squashed"), T.title_core(F.concat(F.lit("The "), F.col("p_type"), F.lit(": "), name)).alias("core"))


@query(r"""SELECT page_id, string_split(url, '/')[-1] AS leaf, regexp_extract(url, '^(.*)/', 1) AS parent, regexp_replace('item-' || page_id || CASE WHEN length(url) > 40 THEN '-long' ELSE '-short' END, '-(short|long)$', '') AS item FROM pages""")
def decoded_keys(spark, sf_dir):
    """Keys taken apart: last part, all before it, and without a suffix."""
    key = F.concat(F.lit("item-"), F.col("page_id").cast("string"), F.when(F.length("url") > 40, "-long").otherwise("-short"))
    return table(spark, sf_dir, "pages").select("page_id", F.substring_index("url", "/", -1).alias("leaf"), F.regexp_extract("url", "(?s)^(.*)/", 1).alias("parent"), F.regexp_replace(key, "-(short|long)$", "").alias("item"))


@query("""WITH i AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark WHERE len(string_split(text, ' ')) >= 6), r AS (SELECT item_id, 'Question: ' || array_to_string(w[5:], ' ') || chr(10) || 'A. ' || w[1] || chr(10) || 'B. ' || w[2] || chr(10) || 'C. ' || w[3] || chr(10) || 'D. ' || w[4] || chr(10) || 'Answer with the letter.' AS t FROM i)
SELECT item_id, md5(t) AS rendered, md5(replace(t, 'Answer with the letter.', 'Reply with one letter only.')) AS reworded FROM r WHERE (length(t) - length(replace(t, 'Answer with the letter.', ''))) = 23""")
def rendered_options(spark, sf_dir):
    """Questions with lettered options, and with the instruction in other words where it occurs exactly once."""
    w, old = F.split("text", " "), F.lit("Answer with the letter.")
    options = F.array_join(F.array(*[F.concat(F.lit(f"{x}. "), F.get(w, F.lit(i))) for i, x in enumerate("ABCD")]), "\n")
    i = table(spark, sf_dir, "benchmark").where(F.size(w) >= 6).select("item_id", F.concat(F.lit("Question: "), F.array_join(F.slice(w, F.lit(5), F.size(w)), " "), F.lit("\n"), options, F.lit("\n"), old).alias("t"))
    once = F.size(F.split("t", r"Answer with the letter\.")) == 2
    return i.where(once).select("item_id", F.md5("t").alias("rendered"), F.md5(F.replace("t", old, F.lit("Reply with one letter only."))).alias("reworded"))


#: Forms that an answer is given in after a text, with marks for its letter or its number.
FORMS = ["\nAnswer: <letter>", "\nThus the answer is (<letter>).", "\n**Answer:** <letter>", "\nAnswer: A. No, wait: **Answer: <letter>**", "\n\\boxed{<letter>}", "\n\\boxed{<number>}", "\n\\boxed{ $<number> cm } and 7 more", "\nso it is <number>"]
ANSWER_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '" + re.sub("<(letter|number)>", r"' || \1 || '", t) + "'" for k, t in enumerate(FORMS)) + " END"


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, chr((65 + doc_id // 8 % 4)::INTEGER) AS letter, (doc_id * 37 % 9973)::VARCHAR AS number FROM documents)
SELECT doc_id, sha256(t || {ANSWER_SQL}) AS digest, CASE WHEN doc_id % 8 < 5 THEN letter END AS letter, CASE WHEN doc_id % 8 >= 5 THEN number END AS number FROM d""")
def parsed_answers(spark, sf_dir):
    """The last letter or the last number of whole texts that end in an answer, in all its forms. SQL knows which answer was
    put there and does not parse."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.char(65 + F.expr("doc_id div 8 % 4")).alias("letter"), (F.col("doc_id") * 37 % 9973).cast("string").alias("number"))

    def form(text):
        return F.concat("t", *[F.col(x[1:-1]) if x in ("<letter>", "<number>") else F.lit(x) for x in re.split("(<letter>|<number>)", text)])

    full = docs.select("doc_id", F.get(F.array(*map(form, FORMS)), (F.col("doc_id") % 8).cast("int")).alias("t"))
    lettered = F.col("doc_id") % 8 < 5
    return full.select("doc_id", F.sha2("t", 256).alias("digest"), F.when(lettered, T.last_choice("t")).alias("letter"), F.when(~lettered, T.last_number("t")).alias("number"))


@query("""SELECT item_id, length, swap, layout, item_id || '/' || length || '/' || swap || '/' || layout AS case_id FROM benchmark, (VALUES ('short'), ('long')) a(length), (VALUES (0), (1)) b(swap), (VALUES ('list'), ('table'), ('prose')) c(layout)""")
def case_grid(spark, sf_dir):
    """Every item in both lengths, both orders and three layouts."""
    grid = table(spark, sf_dir, "benchmark").select("item_id")
    for name, values in {"length": ["short", "long"], "swap": [0, 1], "layout": ["list", "table", "prose"]}.items():
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return grid.withColumn("case_id", F.concat_ws("/", "item_id", "length", "swap", "layout"))


@query("""WITH g AS (SELECT s_suppkey, s_suppkey % 4 AS r, (s_suppkey // 4) % 4 AS c FROM supplier), x AS (SELECT unnest(range(0, 4)) AS i), y AS (SELECT unnest(range(0, 4)) AS j)
SELECT s_suppkey, i::INTEGER AS bay, j::INTEGER AS vault, CASE WHEN i = r AND j = c THEN 'target' WHEN i = r THEN 'row' ELSE 'column' END AS kind FROM g, x, y WHERE i = r OR j = c""")
def distractor_grid(spark, sf_dir):
    """A target in a grid of four by four, with all that share its row or its column as confusers."""
    g = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 4).alias("r"), (F.floor(F.col("s_suppkey") / 4) % 4).alias("c"))
    cells = g.withColumn("bay", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("vault", F.explode(F.sequence(F.lit(0), F.lit(3)))).where("bay = r OR vault = c")
    return cells.select("s_suppkey", "bay", "vault", F.expr("CASE WHEN bay = r AND vault = c THEN 'target' WHEN bay = r THEN 'row' ELSE 'column' END").alias("kind"))


@query("""SELECT d.r_name AS destination, kind, s.r_name AS source FROM region d, (VALUES ('own'), ('foreign'), ('none')) k(kind) LEFT JOIN region s ON (kind = 'own' AND s.r_name = d.r_name) OR (kind = 'foreign' AND s.r_name <> d.r_name)""")
def source_expansion(spark, sf_dir):
    """Each destination by kind with the sources that the kind allows: itself, all others, or none."""
    names = table(spark, sf_dir, "region").agg(F.collect_set("r_name").alias("every"))
    d = table(spark, sf_dir, "region").select("r_name").join(F.broadcast(names)).withColumn("kind", F.explode(F.array(*map(F.lit, ("own", "foreign", "none")))))
    allowed = F.filter("every", lambda s: F.when(F.col("kind") == "own", s == F.col("r_name")).when(F.col("kind") == "foreign", s != F.col("r_name")).otherwise(F.lit(False)))
    return d.select(F.col("r_name").alias("destination"), "kind", F.explode_outer(allowed).alias("source"))


@query("""WITH k AS (SELECT p_partkey, list_sort(string_split(p_type, ' ')) AS options, p_size FROM part), r AS (SELECT options, p_size, count(*) AS n, min(p_partkey) AS first FROM k GROUP BY ALL HAVING count(*) > 1)
SELECT p_partkey, first, n FROM k JOIN r USING (options, p_size) WHERE p_partkey <> first""")
def option_keys(spark, sf_dir):
    """Items whose set of options another item before them has too."""
    k = table(spark, sf_dir, "part").select("p_partkey", F.sort_array(F.split("p_type", " ")).alias("options"), "p_size")
    r = k.groupBy("options", "p_size").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first")).where("n > 1")
    return k.join(r, ["options", "p_size"]).where("p_partkey <> first").select("p_partkey", "first", "n")


@query(r"""WITH t AS (SELECT item_id, regexp_extract_all(lower(split_part(text, chr(10), 1)), '[\p{L}\p{N}_]+') AS w FROM benchmark UNION ALL SELECT item_id + 1000000, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') FROM benchmark),
p AS (SELECT item_id, 'phrase' AS kind, array_to_string(w, ' ') AS p FROM t WHERE len(w) BETWEEN 4 AND 12 UNION ALL SELECT item_id, 'gram', unnest(list_distinct(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')))) FROM t WHERE len(w) >= 13),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS place, w[i:i + 12] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)), n AS (SELECT doc_id, place, array_to_string(g[1:k], ' ') AS p FROM g, range(4, 14) t(k) WHERE len(g) >= k),
m AS (SELECT item_id, doc_id, kind, min(place) AS place FROM p JOIN n USING (p) GROUP BY ALL UNION ALL SELECT item_id, doc_id, 'equal', 0 FROM t JOIN d USING (w) WHERE len(w) > 0)
SELECT item_id, kind, count(*) AS docs, min(doc_id) AS first_doc, arg_min(place, doc_id)::INTEGER AS first_place, sum(place)::BIGINT AS places FROM m GROUP BY 1, 2""")
def phrase_audit(spark, sf_dir):
    """Documents that hold an item's first line, or (numbered a million on) its whole text: short ones as whole phrases, long
    ones by their 13-word grams, all by equality; how many, and the first document with the first place in it."""
    bench = table(spark, sf_dir, "benchmark")
    asked = bench.select("item_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("text")).unionAll(bench.select(F.col("item_id") + 1_000_000, "text"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = screen.phrase_matches(docs, "doc_id", "text", asked, "item_id", "text")
    first = F.min(F.struct("doc_id", "place"))
    return found.groupBy("item_id", "kind").agg(F.count(F.lit(1)).alias("docs"), first["doc_id"].alias("first_doc"), first["place"].alias("first_place"), F.sum("place").alias("places"))


@query(r"""WITH d AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS first, source, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')[1:12])) AS key FROM documents), k AS (SELECT *, min(doc_id) OVER (PARTITION BY key) AS key_first FROM d),
r AS (SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN first <> doc_id THEN 'known' WHEN key_first <> doc_id THEN 'same options' WHEN length(text) < 200 THEN 'short' ELSE 'kept' END AS reason FROM k)
SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def exclusion_chain(spark, sf_dir):
    """Reasons in a fixed order, each row under the first that holds: empty, known text, known key, short, or kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sort_array(F.array_distinct(F.slice(T.words("text"), 1, 12))).alias("key"))
    first = lambda c, name: docs.groupBy(c).agg(F.min("doc_id").alias(name))
    null_safe = lambda d, other, c: d.join(other.withColumnRenamed(c, "_c"), F.col(c).eqNullSafe(F.col("_c"))).drop("_c")
    both = null_safe(null_safe(docs, first("text", "first"), "text"), first("key", "key_first"), "key")
    reason = F.when(F.col("text").isNull() | (F.trim("text") == ""), "empty").when(F.col("first") != F.col("doc_id"), "known").when(F.col("key_first") != F.col("doc_id"), "same options").when(F.length("text") < 200, "short").otherwise("kept")
    return both.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS k FROM conversations), c AS (SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY k) AS t FROM t WHERE k <= 8 GROUP BY conv_id)
SELECT conv_id, turns, md5(t) AS digest, length(t)::INTEGER AS chars FROM c WHERE length(t) <= 20000""")
def assembled_conversations(spark, sf_dir):
    """Conversations in order of turns, eight turns and 20,000 characters at most; too few of them are an error."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), 1, 8).alias("t"))
    whole = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), F.coalesce(x["text"], F.lit("")))), "\n")
    return enough(turns.select("conv_id", F.size("t").cast("long").alias("turns"), whole.alias("text")).where("length(text) <= 20000"), 10).select("conv_id", "turns", F.md5("text").alias("digest"), F.length("text").alias("chars"))


def enough(rows: DataFrame, least: int) -> DataFrame:
    """rows as they are; reading them fails where there are fewer."""
    checked = rows.agg(F.count(F.lit(1)).alias("_n")).select(F.when(F.col("_n") >= least, F.lit(True)).otherwise(F.raise_error(F.lit(f"fewer than {least} rows")).cast("boolean")).alias("_ok"))
    return rows.join(F.broadcast(checked), F.col("_ok")).drop("_ok")


@query(r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, text, l, list_filter(range(1, len(l) + 1), lambda i: length(l[i]) >= 20 AND len(list_filter(l, lambda y: y = l[i])) = 1) AS k FROM l WHERE len(l) >= 3),
p AS (SELECT doc_id, l, l[k[1]] AS target, l[k[2]] AS other, array_to_string(list_filter(l, lambda x: x <> l[k[1]]), chr(10)) AS removed, text FROM u WHERE len(k) >= 2)
SELECT doc_id, state, role, md5(CASE WHEN state = 'present' THEN text ELSE removed END) AS body, md5(CASE WHEN role = 'gold' THEN target ELSE other END) AS answer FROM p, (VALUES ('present'), ('removed')) a(state), (VALUES ('gold'), ('wrong')) b(role)""")
def target_removed(spark, sf_dir):
    """Texts with and without their first unique long line, each with that line and with another as answer."""
    lines = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", F.split("text", "\n").alias("l")).where("size(l) >= 3")
    each = lines.select("doc_id", F.posexplode("l").alias("i", "x")).groupBy("doc_id", "x").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("i")).where("n = 1 AND length(x) >= 20")
    first = each.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("i", "x"))), 1, 2)["x"].alias("k")).where("size(k) = 2")
    p = lines.join(first, "doc_id").withColumn("removed", F.array_join(F.filter("l", lambda x: x != F.get("k", F.lit(0))), "\n"))
    gone = F.length("text") - F.length("removed") == F.length(F.get("k", F.lit(0))) + 1
    p = p.withColumn("removed", F.when(gone, F.col("removed")).otherwise(F.raise_error(F.lit("the line was not removed once"))))
    p = p.withColumn("state", F.explode(F.array(F.lit("present"), F.lit("removed")))).withColumn("role", F.explode(F.array(F.lit("gold"), F.lit("wrong"))))
    return p.select("doc_id", "state", "role", F.md5(F.when(F.col("state") == "present", F.col("text")).otherwise(F.col("removed"))).alias("body"), F.md5(F.get("k", F.when(F.col("role") == "gold", 0).otherwise(1))).alias("answer"))


@query("""WITH t AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids FROM lineitem GROUP BY 1), p AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pre FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1)
SELECT l_orderkey, ids[1:len(pre)] = pre AS kept, len(pre)::INTEGER AS n, sha256(array_to_string(ids[len(pre) + 1:], ' ')) AS suffix FROM t JOIN p USING (l_orderkey)""")
def prefix_kept(spark, sf_dir):
    """Whether a sequence begins with its prefix, and the digest of what follows."""
    every = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("t"))
    p = every.select("l_orderkey", F.col("t.l_partkey").alias("ids"), F.filter("t", lambda x: x["l_linenumber"] <= 2)["l_partkey"].alias("pre")).where("size(pre) > 0")
    rest = F.slice("ids", F.size("pre") + 1, F.size("ids"))
    return p.select("l_orderkey", (F.slice("ids", F.lit(1), F.size("pre")) == F.col("pre")).alias("kept"), F.size("pre").alias("n"), F.sha2(F.array_join(F.transform(rest, lambda x: x.cast("string")), " "), 256).alias("suffix"))


@query("""SELECT p_brand, count(*) AS n, count(DISTINCT p_size) AS sizes, count(DISTINCT p_size) = (SELECT count(DISTINCT p_size) FROM part) AND count(p_retailprice) = count(*) AS complete FROM part WHERE starts_with(p_brand, 'Brand#1') GROUP BY 1""")
def frozen_subset(spark, sf_dir):
    """The groups that a prefix of their id freezes; complete are those with every size that there is, and no price missing."""
    part = table(spark, sf_dir, "part")
    every = part.agg(F.countDistinct("p_size").alias("every"))  # an aggregate without keys: one row
    own = part.where(F.startswith("p_brand", F.lit("Brand#1"))).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_size").alias("sizes"), F.count("p_retailprice").alias("priced"))
    return own.crossJoin(F.broadcast(every)).select("p_brand", "n", "sizes", ((F.col("sizes") == F.col("every")) & (F.col("priced") == F.col("n"))).alias("complete"))


@query("""WITH c AS (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_discount, l_returnflag || l_linestatus || l_linenumber AS candidate FROM lineitem WHERE l_tax = 0.08)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, candidate FROM lineitem JOIN c USING (l_returnflag, l_linestatus, l_linenumber, l_discount)""")
def matched_candidates(spark, sf_dir):
    """Candidates that agree in all four parameters."""
    keys, lines = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount"], table(spark, sf_dir, "lineitem")
    c = lines.where("l_tax = 0.08").select(*keys, F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("candidate")).distinct()
    return lines.join(c, keys).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "candidate")


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents), k AS (SELECT doc_id, w, h, i, ((len(w) - 16) * i // 2) AS p FROM w, (VALUES (8), (32)) a(h), (VALUES (0), (1), (2)) b(i) WHERE len(w) >= 64)
SELECT doc_id, h, i, p::BIGINT AS p, sha256(array_to_string(w[greatest(p - h, 0) + 1:p], ' ')) AS history, sha256(array_to_string(w[p + 1:p + 16], ' ')) AS measured FROM k""")
def span_cases(spark, sf_dir):
    """Spans of sixteen words at three evenly spaced places, after histories of two lengths, by their digests."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "").alias("w")).where("size(w) >= 64")
    k = w.withColumn("h", F.explode(F.array(F.lit(8), F.lit(32)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("p", F.expr("(size(w) - 16) * i div 2"))
    part = lambda a, n: F.sha2(F.array_join(F.slice("w", a, n), " "), 256)
    begin = F.greatest(F.col("p") - F.col("h"), F.lit(0))
    return k.select("doc_id", "h", "i", "p", part((begin + 1).cast("int"), (F.col("p") - begin).cast("int")).alias("history"), part((F.col("p") + 1).cast("int"), F.lit(16)).alias("measured"))


@query(r"""WITH b AS (SELECT doc_id, hex(encode(text)) AS x, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL AND contains(text, chr(10))), f AS (SELECT doc_id, x, n, f, (n * f // 100) AS p FROM b, (VALUES (25), (65)) v(f)),
l AS (SELECT doc_id, f, n, p, x, regexp_extract(x[2 * p + 1:], '^((?:[1-9A-F][0-9A-F]|0[0-9B-F])*)0A', 1) AS skipped, regexp_matches(x[2 * p + 1:], '^(?:[1-9A-F][0-9A-F]|0[0-9B-F])*0A') AS found FROM f)
SELECT doc_id, f, (p + length(skipped) // 2 + 1)::BIGINT AS start, sha256(unhex(x[2 * (p + length(skipped) // 2 + 1) + 1:2 * (p + length(skipped) // 2 + 1 + 64)])) AS slice FROM l WHERE found""")
def byte_slices(spark, sf_dir):
    """64 bytes after the next line break behind a quarter and behind 65 % of a text's bytes."""
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("\n"))).withColumn("f", F.explode(F.array(F.lit(25), F.lit(65))))
    return docs.select("doc_id", "f", T.byte_slice("text", "f", 64).alias("s")).where("s IS NOT NULL").select("doc_id", "f", "s.start", F.sha2("s.bytes", 256).alias("slice"))


@query(r"""WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 1 AS n FROM documents WHERE text IS NOT NULL), o AS (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM w), t AS (SELECT sum(n) AS t FROM w)
SELECT doc_id, greatest(a, t // 4)::BIGINT AS "from", least(a + n, t // 4 * 3)::BIGINT AS "to" FROM o, t WHERE a + n > t // 4 AND a < t // 4 * 3""")
def continued_stream(spark, sf_dir):
    """The documents' parts of a stream of tokens that goes on from a quarter of it, up to three quarters."""
    from tessella.operators.packing import offsets

    n = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")) + 1
    w = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", n.cast("long").alias("n"))
    total = w.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    low, high = total // 4, total // 4 * 3
    o = offsets(w, "doc_id", "n")
    return o.where((F.col("start") + F.col("n") > low) & (F.col("start") < high)).select("doc_id", F.greatest("start", F.lit(low)).alias("from"), F.least(F.col("start") + F.col("n"), F.lit(high)).alias("to"))
