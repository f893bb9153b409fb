import base64
import hashlib
import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_ngram_jaccard import brute as components
from tests.llm.test_repeats import brute as repeats


def tables(folder, spark):
    """Clean documents, and planted cases of every kind; ids of each kind."""
    r = random.Random(6)
    parts = ["ba", "ko", "mi", "tu", "re", "la", "ne", "so", "vi", "da", "po", "ga"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randrange(2, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, labels, kinds = {}, [], {"toxic": [], "copy": [], "passage": [], "leak": []}
    for i in range(260):
        docs[i] = text(r.randrange(20, 90))
        if i % 4 == 0:
            words = docs[i].split()
            for _ in range(6):
                words[r.randrange(len(words))] = "zxgrum" + r.choice(parts)
            docs[i] = " ".join(words)
            kinds["toxic"].append(i)
        labels.append((i, 1, int(i % 4 == 0)))
    whole = text(120)
    for i in range(300, 306):
        words = whole.split()
        words[i - 300] = "edited"
        docs[i] = " ".join(words) if i > 300 else whole
        kinds["copy"].append(i)
    shared = text(50)
    for i in range(400, 404):
        docs[i] = f"{text(60)} {shared} {text(60)}"
        kinds["passage"].append(i)
    items = [(i, text(25)) for i in range(4)]
    for i, t in items:
        docs[500 + i] = f"{text(40)} {t.upper()}. {text(30)}"
        kinds["leak"].append(500 + i)
    docs |= {600: None, 601: "", 602: "a"}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    frames = {"documents": (rows, "doc_id long, text string, lang string, source string, n_chars long"), "labels": (labels, "doc_id long, quality int, toxic int"), "benchmark": (items, "item_id long, text string")}
    for name, (found, schema) in frames.items():
        spark.createDataFrame(found, schema).write.parquet(f"{folder}/{name}.parquet")
    return docs, kinds


def test_every_stage_on_its_own_input(spark, tmp_path):
    docs, kinds = tables(tmp_path, spark)
    out, frame = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, frame, str(tmp_path))
        done.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "byte_bpe":
            assert frame.columns == columns
            out[name] = {x.doc_id: x.text for x in frame.collect()}
    left = out["toxicity"]
    lost = set(docs) - set(left)
    assert len(lost & set(kinds["toxic"])) >= 0.9 * len(kinds["toxic"]) and len(lost - set(kinds["toxic"])) <= 3
    rows = list(left.items())
    assert set(out["ngram_jaccard"]) == {d for d, _, c in components(rows, 5, 80) if d == c}
    before = list(out["ngram_jaccard"].items())
    words = [(t or "").encode().split() for _, t in before]
    for (i, t), w, gone in zip(before, words, repeats(words, 35)):
        assert out["substring_dedup"][i] == (b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else t)
    assert set(out["substring_dedup"]) - set(out["decontaminate"]) == set(kinds["leak"]) & set(before and dict(before))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    truth = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {x.doc_id: (list(x.ids), x.decoded_sha256) for x in frame.collect()}
    assert got == {i: (truth.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in out["decontaminate"].items()}
    again = {x.doc_id: (list(x.ids), x.decoded_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == got
