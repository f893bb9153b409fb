import html
import math
import random
from collections import Counter

from tessella.llm import language_id


def text(lang, r, n):
    parts = {"aa": ["bal", "kor", "mit"], "bb": ["zuw", "xev", "qij"]}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))


def docs(spark, r):
    return spark.createDataFrame([(i, text(lang, r, 60), lang, 1.0) for i in range(60) for lang in ("aa", "bb")] + [(900, None, "aa", 1.0), (901, "x", None, 1.0)], "doc_id long, text string, lang string, posterior double")


def test_evidence_is_fused(spark):
    r = random.Random(1)
    page = lambda lang, n, declared="": f"<html{f' lang={declared!r}' if declared else ''}><script>zuw xev</script><p>{text(lang, r, n)}</p>"
    rows = [(i, f"https://{lang}host.example/{i}", page(lang, 40, lang)) for i in range(40) for lang in ("aa", "bb")]
    rows += [(100, "https://aahost.example/1", None), (101, "https://bbhost.example/x", ""), (102, "https://new.example/", "<html lang='bb-XX'>"), (103, None, page("aa", 50)), (104, "http://[bad", page("bb", 50)), (105, "https://aahost.example/y", page("bb", 80)), (105, "https://aahost.example/y", page("bb", 80))]
    rows += [(200, "https://new.example/z", page("bb", 60_000))]
    got = language_id.identify(spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, html string, lang string"), docs(spark, r)).collect()
    assert len(got) == len(rows)
    lang = {x.page_id: x for x in got if x.page_id >= 100}
    assert all(x.lang == x.text_lang == x.url[8:10] for x in got if x.page_id < 100)
    assert (lang[100].lang, lang[100].text_lang) == ("aa", None)
    assert (lang[101].lang, lang[102].lang, lang[103].lang, lang[104].lang, lang[105].lang, lang[200].lang) == ("bb", "bb", "aa", "bb", "bb", "bb")
    assert all(0.5 <= x.posterior <= 1 + 1e-9 for x in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert language_id.identify(none, docs(spark, random.Random(2))).count() == 0
    one = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    assert [x.lang for x in language_id.identify(one, spark.createDataFrame([], "doc_id long, text string, lang string")).collect()] == [None]


def test_address():
    assert language_id.address("https://A.Example.ORG:80/de-AT/x?y") == ("a.example.org", "org", "de")
    assert language_id.address("https://a.b/de") == ("a.b", "b", "de")
    assert language_id.address(None) == language_id.address("") == language_id.address("http://[x") == ("", "", "")


def brute(pages, docs):
    """The same fusion by plain loops over all pages, from the formulas."""
    langs = sorted({lang for _, body, lang in docs if body is not None and lang is not None})

    def places(body):
        raw = f" {body.lower()} ".encode()
        return [((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> 18 for a, b, c in zip(raw, raw[1:], raw[2:])] if len(raw) >= 5 else []

    grams = {lang: Counter(p for _, body, x in docs if x == lang and body is not None for p in places(body)) for lang in langs}
    size = {lang: sum(grams[lang].values()) + 0.1 * language_id.SLOTS for lang in langs}
    seen = []
    for page_id, url, page in pages:
        found = places(" ".join(html.unescape(language_id.MARKUP.sub(" ", page or "")).split()))
        ll = [language_id.WEIGHT * sum(math.log((grams[x][p] + 0.1) / size[x]) for p in found) for x in langs]
        top = max(ll)
        r = [math.exp(x - top) for x in ll] if found else [0.0 for _ in ll]
        r = [x / (sum(r) or 1) for x in r]
        declared = language_id.DECLARED.search(page or "")
        host, suffix, code = language_id.address(url)
        seen.append((page_id, host, suffix, declared[1].lower() if declared else "", code, ll, r))
    out = []
    for page_id, host, suffix, declared, code, ll, r in seen:
        score = []
        for k in range(len(langs)):
            every = [sum(x[6][j] for x in seen) for j in range(len(langs))]
            prior = [(x + 1) / (sum(every) + len(langs)) for x in every]
            over = [sum(x[6][j] for x in seen if x[2] == suffix) + language_id.SUFFIX_PRIOR * prior[j] for j in range(len(langs))]
            own = max(0.0, sum(x[6][k] for x in seen if x[1] == host) - r[k]) + language_id.HOST_PRIOR * over[k] / sum(over)
            total = ll[k] + math.log(own)
            for place, value in ((3, declared), (4, code)):
                if value:
                    total += math.log((sum(x[6][k] for x in seen if x[place] == value) + language_id.SMOOTH) / (every[k] + 2 * language_id.SMOOTH))
            score.append(total)
        best = score.index(max(score))
        spread = sum(math.exp(x - score[best]) for x in score)
        out.append((page_id, langs[best], round(1 / spread, 5), langs[r.index(max(r))] if any(r) else None))
    return sorted(out)


def test_equals_brute_force(spark):
    r = random.Random(5)
    body = lambda n: " ".join("".join(r.choice(["bal", "kor", "zuw", "xev", "mit"]) for _ in range(r.randrange(1, 3))) for _ in range(n))
    docs_ = [(i, text(lang, r, r.randrange(1, 20)), lang) for i in range(25) for lang in ("aa", "bb")] + [(60, body(40), "cc"), (61, None, "aa"), (62, "x", None), (63, "", "bb")]
    pages = []
    for i in range(90):
        url = r.choice(["https://one.example/aa/x", "http://two.example/bb-XX/", "https://three.test/", "", None, "https://one.example/p?q"])
        declared = r.choice(["", " lang=aa", ' lang="bb-XX"', " lang='qq'"])
        pages.append((i, url, r.choice([None, "", f"<html{declared}>", *[f"<html{declared}><p>{body(r.randrange(1, 9))}&amp;</p>"] * 6])))
    pages += pages[:5]
    got = language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), spark.createDataFrame(docs_, "doc_id long, text string, lang string")).collect()
    want = brute(pages, docs_)
    got = sorted((x.page_id, x.lang, round(x.posterior, 5), x.text_lang) for x in got)
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert all(abs(a[2] - b[2]) < 1e-4 for a, b in zip(got, want))
    assert len({x[1] for x in got}) > 1 and any(x[1] != x[3] for x in got if x[3])
