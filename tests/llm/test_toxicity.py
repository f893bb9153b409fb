import random
import zlib

import numpy as np

from tessella.llm import toxicity


def corpus(n=500, seed=1):
    r = random.Random(seed)
    plain = [a + b for a in ("ba", "ko", "mi", "tu", "re") for b in ("la", "ne", "so", "vi", "da", "po")]
    rude = ["grumfa", "grumfel", "grumfix", "grumfo"]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(plain) + r.choice(plain) for _ in range(r.randrange(5, 120))]
        toxic = int(r.random() < 0.3)
        if toxic:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(rude) + r.choice(["", "s", "ta"])
        docs.append((i, " ".join(words), "x", -1.0))
        labels.append((i, 1, toxic))
    return docs, labels


SCHEMA, MARKS = "doc_id long, text string, lang string, score double", "doc_id long, quality int, toxic int"


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus()
    docs += [(9000, None, "x", 0.0), (9001, "", "x", 0.0), (9002, " \n", "x", 0.0), (None, "grumfa " * 9, "x", 0.0), (9003, "GRUMFELTA " * 9, "x", 0.0), (9004, "bala " * 50_000 + "x" * 5_000, "x", 0.0)]
    got = {x.doc_id: x for x in toxicity.score(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, MARKS)).collect()}
    assert len(got) == len(docs)
    for i, _, _, _ in docs:
        assert got[i].held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0)
        assert 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.5)
    held = [(x, t) for x, _, t in labels if got[x].held_out]
    right = sum(got[x].predicted == t for x, t in held)
    assert right >= 0.95 * len(held)
    assert got[9000].score == got[9001].score == got[9002].score < 0.5
    assert got[9003].predicted == 1


def test_held_out_labels_change_nothing(spark):
    docs, labels = corpus(300)
    frame = spark.createDataFrame(docs, SCHEMA)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (sorted((x.doc_id, round(x.score, 9)) for x in toxicity.score(frame, spark.createDataFrame(m, MARKS)).collect()) for m in (labels, flipped))
    assert a == b


def test_without_two_classes_or_rows(spark):
    docs, labels = corpus(40)
    frame = spark.createDataFrame(docs, SCHEMA)
    none = spark.createDataFrame([], MARKS)
    assert {x.score for x in toxicity.score(frame, none).collect()} == {0.0}
    assert {x.score for x in toxicity.score(frame, spark.createDataFrame([(i, 1, 0) for i in range(40)], MARKS)).collect()} == {0.0}
    assert toxicity.score(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_toxic_rows_go_with_all_columns(spark):
    docs, labels = corpus(300)
    frame, marks = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, MARKS)
    bad = {x.doc_id for x in toxicity.score(frame, marks).where("predicted = 1").collect()}
    left = toxicity.drop_toxic(frame, marks)
    assert left.columns == frame.columns
    assert {x.doc_id for x in left.collect()} == {d[0] for d in docs} - bad


def test_grams_begin_with_their_word():
    g, c, low, n = toxicity.grams([b"ab", b"abc", b"longer than depth"[:14].replace(b" ", b"-")])
    assert n.tolist() == [3, 4, toxicity.DEPTH]
    assert g[0] == g[3] and g[1] == g[4] and g[2] != g[5]
    assert c[1] == g[0] and c[2] == c[5] == g[1]
    assert low[1] == ord("b") | ord("a") << 8 | 32 << 16


def test_logistic_weights():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 2)) * [3, 0.1] + [1, 5]
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] - 2)))
    w = toxicity.logistic(x, (r.random(4000) < p).astype(float))
    assert abs(w[1] - 1.5) < 0.2


def test_all_bytes_of_long_words_count(spark):
    """Words that differ after their first 24 bytes only."""
    r, docs, labels = random.Random(5), [], []
    same = "unverhaeltnismaessigkeits"
    for i in range(400):
        toxic = int(r.random() < 0.4)
        docs.append((i, " ".join(same + ("grumfa" if toxic and k < 3 else r.choice(["bala", "kone", "miso"])) for k in range(12)), "x", 0.0))
        labels.append((i, 1, toxic))
    got = {x.doc_id: x for x in toxicity.score(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, MARKS)).collect()}
    held = [(x, t) for x, _, t in labels if got[x].held_out]
    assert held and all(got[x].predicted == t for x, t in held)
    assert toxicity.grams([b"x" * 50, b"y"])[3].tolist() == [51, 2]


def test_model_keeps_all_grams_in_any_number_of_blocks(spark, monkeypatch):
    docs, labels = corpus(300)
    frame, marks = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, MARKS)
    scores = lambda: sorted((x.doc_id, round(x.score, 6)) for x in toxicity.score(frame, marks).collect())
    whole = scores()
    monkeypatch.setattr(toxicity, "BLOCK", 40)
    monkeypatch.setattr(toxicity, "HELD", 2)
    monkeypatch.setattr(toxicity, "NEW", 50)
    assert scores() == whole
    rows = spark.createDataFrame([(t, packed(x)) for (_, x, _, _), (_, _, t) in zip(docs, labels)], "toxic int, packed binary")
    model = toxicity.train(rows, toxicity.common.Scratch(spark))
    words = list({w for _, x, _, _ in docs for w in x.encode().split()})
    one, many = toxicity.Evidence(toxicity.files(model)), toxicity.Evidence(toxicity.files(model))
    monkeypatch.setattr(toxicity, "HELD", 1000)
    all_held = toxicity.Evidence(toxicity.files(model))
    monkeypatch.setattr(toxicity, "HELD", 2)
    for x in (one, all_held):
        x.learn(words)
    assert one == all_held and any(one.values())
    assert [x.tolist() for x in many.of(iter([words[:70], [], words[70:]]))] == [[one[w] for w in x] for x in (words[:70], [], words[70:])]
    kept = model.where("kind = 0")
    count = {0: {}, 1: {}}
    for (_, x, _, _), (_, _, t) in zip(docs, labels):
        for g in toxicity.grams(x.encode().split())[0].tolist():
            count[t][g] = count[t].get(g, 0) + 1
    want = {g for t in (0, 1) for g, n in count[t].items() if n > 1}
    assert model.blocks > 2 and sorted(x.g for x in kept.collect()) == sorted(want)


def packed(text):
    return toxicity.zstandard.ZstdCompressor(3).compress(text.encode())


def test_label_bits_hold_every_label(spark):
    marks = spark.range(0, 3000, 3).withColumnRenamed("id", "doc_id")
    bits = toxicity.label_bits(marks)
    got = np.array([x.s for x in spark.range(3000).withColumnRenamed("id", "doc_id").select("doc_id", toxicity.slot(64 * len(bits)).alias("s")).orderBy("doc_id").collect()])
    assert toxicity.may_have(bits, got[::3]).all() and toxicity.may_have(bits, got).mean() < 0.5


def test_evidence_against_plain_kneser_ney(spark):
    """The same two models, written with dictionaries of byte strings."""
    docs, labels = corpus(120)
    rows = spark.createDataFrame([(t, packed(x)) for (_, x, _, _), (_, _, t) in zip(docs, labels)], "toxic int, packed binary")
    model = toxicity.Evidence(toxicity.files(toxicity.train(rows, toxicity.common.Scratch(spark))))
    counts, less = ({}, {}), toxicity.SHARED_DISCOUNT
    off = lambda n: min(n, 1) + toxicity.DISCOUNT * (min(n, toxicity.DISCOUNTED) - min(n, 1))
    cut = lambda w: [(b" " + w + b" ")[max(0, j + 1 - toxicity.DEPTH) : j + 1] for j in range(1, len(w) + 2)]
    for (_, x, _, _), (_, _, t) in zip(docs, labels):
        for w in x.encode().split():
            for g in cut(w):
                counts[t][g] = counts[t].get(g, 0) + 1
    every = set(counts[0]) | set(counts[1])

    def log_likelihood(word, own):
        total = 0.0
        for g in cut(word):
            context = {k: n for k, n in own.items() if len(k) == len(g) and k[:-1] == g[:-1]} if len(g) == toxicity.DEPTH or g[:1] == b" " else {}
            n = sum(context.values())
            rest = sum(map(off, context.values())) / n if n else 1.0
            total += np.log((own.get(g, 0) - off(own.get(g, 0))) / n + rest * shared(g[-4:])) if n else np.log(shared(g[-4:]))
        return total

    four = {}
    for g in every:
        four[g[-4:]] = four.get(g[-4:], 0) + 1
    two = {}
    for g in four:
        two[g[-2:]] = two.get(g[-2:], 0) + 1

    def shared(g):
        def part(table, key, below):
            same = {k: n for k, n in table.items() if k[:-1] == key[:-1] and len(k) == len(key)}
            return (table[key] - less) / sum(same.values()) + less * len(same) / sum(same.values()) * below

        return part(four, g, part(two, g[-2:], 1 / 256))

    words = sorted({w for _, x, _, _ in docs for w in x.encode().split()})[:40]
    model.learn(words)
    for w in words:
        assert abs(model[w] - (log_likelihood(w, counts[1]) - log_likelihood(w, counts[0]))) < 1e-3 * max(1, abs(model[w])), w


def test_rare_expressions_teach(spark):
    """A word seen twice or three times in toxic rows only tells more each time; one seen once what its beginnings tell."""
    docs, labels = corpus(200)
    docs += [(500 + i, " ".join(w for k, w in enumerate(["vexonda", "qumbrital", "zolfregin"], 1) if i < k), "x", 0.0) for i in range(3)]
    rows = [(t, packed(x)) for (_, x, _, _), (_, _, t) in zip(docs, labels)] + [(1, packed(x)) for _, x, _, _ in docs[-3:]]
    model = toxicity.Evidence(toxicity.files(toxicity.train(spark.createDataFrame(rows, "toxic int, packed binary"), toxicity.common.Scratch(spark))))
    model.learn([b"vexonda", b"qumbrital", b"zolfregin", b"hyplestam"])
    assert model[b"hyplestam"] == model[b"vexonda"] < model[b"qumbrital"] < model[b"zolfregin"]


def test_a_row_goes_for_its_own_text(spark):
    docs, labels = corpus(300)
    extra = [(None, "grumfa grumfel grumfix grumfo " * 5, "x", 0.0), (None, "bala kone miso tuvi", "x", 0.0), (None, None, "x", 0.0), (7000, "grumfa grumfel grumfix grumfo " * 5, "x", 0.0), (7000, "bala kone miso tuvi", "x", 0.0), (7000, "bala kone miso tuvi", "x", 0.0)]
    frame = spark.createDataFrame(docs + extra, "doc_id long, text string, toxic_id string, k double")
    left = toxicity.drop_toxic(frame, spark.createDataFrame(labels, MARKS))
    assert left.dtypes == frame.dtypes
    got = [tuple(x) for x in left.where("doc_id IS NULL OR doc_id = 7000").collect()]
    assert sorted(got, key=str) == sorted([extra[1], extra[2], extra[4], extra[5]], key=str)
