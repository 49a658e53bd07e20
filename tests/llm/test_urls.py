import math
import random
import re

import regex

from veldra.llm import urls

SCHEMA = "page_id bigint, url string, html string"


def brute_segment(text, share):
    """Best of all splits."""

    def score(words):
        return round(sum(math.log(share[w]) if w in share else math.log(1e-4) - len(w) * math.log(26) for w in words), 9)

    best = None
    for mask in range(1 << max(0, len(text) - 1)):
        words, start = [], 0
        for i in range(1, len(text)):
            if mask >> (i - 1) & 1:
                words.append(text[start:i])
                start = i
        words.append(text[start:])
        key = (round(score(words), 6), -len(words))
        best = max(best, (key, words)) if best and key == best[0] else (key, words) if best is None or key > best[0] else best
    return best


def test_segments_by_trying_all_splits():
    rng = random.Random(1)
    lexicon = ["a", "ab", "ba", "abba", "cab", "bc", "cc", "bca", "aaa"]
    for _ in range(60):
        share = {w: rng.random() / 10 for w in rng.sample(lexicon, 6)}
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 11)))
        got = urls.segment(text, share)
        assert "".join(got) == text
        own = sum(math.log(share[w]) if w in share else math.log(1e-4) - len(w) * math.log(26) for w in got)
        (best, count), _ = brute_segment(text, share)
        assert abs(own - best) < 1e-5 and len(got) <= -count + 0


def test_known_words():
    share = {"cheap": 1e-3, "pills": 1e-3, "online": 1e-3, "on": 1e-2, "line": 1e-3, "expert": 1e-4, "s": 1e-3, "exchange": 1e-4, "experts": 1e-4, "sex": 1e-4, "change": 1e-3}
    assert urls.segment("cheappillsonline", share) == ["cheap", "pills", "online"]
    assert urls.labels("WWW.Cheap-Pills24.example.com") == ["www", "cheap", "pills", "example", "com"]
    assert urls.segment("", share) == [] and urls.segment("zzz", share) == ["zzz"]


def test_naive_bayes_by_hand():
    ratio, odds = urls.train(["bad bad", "casino"], ["good", "casino good good"], 1.0, 0.5)
    # block: bad 2, casino 1, good 0 of 3; allow: bad 0, casino 1, good 3 of 4; three words known.
    assert odds == 0
    assert math.isclose(ratio["bad"], math.log(3 / 6) - math.log(1 / 7))
    assert math.isclose(ratio["good"], math.log(1 / 6) - math.log(4 / 7))
    assert math.isclose(ratio["casino"], math.log(2 / 6) - math.log(2 / 7))


def test_filter(spark):
    rows = [
        (1, "https://www.cheappillsonline.com/buy/pills.html", None), (2, "HTTP://News.Example.ORG/world/article", "<p>world news</p>"), (3, None, ""), (4, "no url", None), (5, "https:///path", None),
        (6, "https://user:pw@freebets.example.com:8080/casino?x=casino#casino", None), (7, "https://127.0.0.1/x", None), (1, "https://www.cheappillsonline.com/buy/pills.html", None), (None, "https://docs.example.com/api", None),
        (8, "https://" + "casino" * 3000 + ".com/", None), (9, "https://greengarden.example.com/", "<b>green</b> garden garden &amp; <script>casino</script>"),
    ]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", host string, score int")
    got = urls.filter_urls(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].blocked and by[1].host_words == ["cheap", "pills", "online"] and by[1].path_words == ["buy", "pills", "html"]
    assert by[6].blocked and by[6].host == "freebets.example.com" and by[6].path_words == ["casino"]
    assert not by[2].blocked and by[2].host == "news.example.org"
    for k in (3, 4, 5):
        assert by[k].host is None and not by[k].blocked and by[k].host_words == []
    assert by[7].host_words == [] and not by[7].blocked
    assert by[8].blocked and set(by[8].host_words) == {"casino"}
    assert by[9].host_words[:2] == ["green", "garden"] and not by[9].blocked
    assert sum(r.page_id == 1 for r in got) == 2
    ratio, odds = urls.train()
    for r in got:
        assert abs(r.score - (odds + sum(ratio.get(w, 0.0) for w in [*r.host_words, *r.path_words]))) < 1e-6
    assert urls.filter_urls(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_hosts(spark):
    """Random letters by the ten thousand, words longer than any label may be, and unknown runs stay whole."""
    rng = random.Random(5)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    word = "donaudampfschifffahrtsgesellschaft"
    rows = [(1, f"https://{noise}.com/x", None), (2, f"https://my{word}.com/", f"<p>{word} {word}</p>"), (3, f"https://{'qz' * 40}.com/", "<p>other</p>")]
    by = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert "".join(by[1].host_words) == noise
    assert by[2].host_words == ["my", word]
    assert by[3].host_words == ["qz" * 40]


def test_scripts_lend_no_words(spark):
    html = "<script type='x'>\nhiddenword\n</script><style>\nstyleword</style><!-- adword -->plainword<p class=\"attrword\">"
    rows = [(k, f"https://{w}{w}.com/", html) for k, w in enumerate(("hiddenword", "styleword", "adword", "attrword", "plainword"))]
    by = {r.page_id: r.host_words for r in urls.filter_urls(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert by == {0: ["hiddenword" * 2], 1: ["styleword" * 2], 2: by[2], 3: ["attrword" * 2], 4: ["plainword"] * 2}
    assert "adword" not in by[2]


def test_trained_on_labelled_addresses(spark):
    rng = random.Random(6)
    good, bad = ["garden", "river", "school", "bread"], ["junk", "fake", "scam", "trick"]
    html = "".join(f"<p>{w} {w}</p>" for w in good + bad)

    def address(kind):
        words = good if kind else bad
        return f"https://{rng.choice(words)}{rng.choice(words)}.example.com/{rng.choice(words)}/{rng.randrange(99)}"

    taught = [(address(k % 2), k % 2 == 0) for k in range(80)] + [(None, True), ("https://x.com/", None)]
    kinds = [rng.random() < 0.5 for _ in range(100)]
    pages = spark.createDataFrame([(k, address(kind), html) for k, kind in enumerate(kinds)], SCHEMA)
    got = {r.page_id: r for r in urls.filter_urls(pages, prior=0.5, labelled=spark.createDataFrame(taught, "url string, blocked boolean")).collect()}
    assert all(got[k].blocked != kind for k, kind in enumerate(kinds))
    assert all(set(got[k].host_words) <= set(good + bad + ["example"]) for k in got)


def plain_filter(pages):
    """The whole filter by hand: counts, shares, all splits that the segmenter allows, and the model."""
    from collections import Counter

    counts = Counter()
    for _, _, html in pages:
        text = re.sub(r"(?s)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&#?[a-z0-9]+;", " ", (html or "").lower())
        counts.update(w for w in regex.split(r"[^\p{L}]+", text) if w)
    total = sum(counts.values()) or 1
    ratio, odds = urls.train()
    for page_id, url, _ in pages:
        found = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)", url or "")
        host = found[1].lower() if found else ""
        words = []
        for label in urls.labels(host):
            if label in urls._COMMON:
                continue
            inside = {label[i:j] for i in range(len(label)) for j in range(i + 1, len(label) + 1)}
            share = {w: 0.8 * counts[w] / total + (0.2 / len(urls.WEB_WORDS) if w in urls.WEB_WORDS else 0) for w in inside}
            words += plain_viterbi(label, {w: p for w, p in share.items() if p})
        words = [w for w in words if w not in urls._COMMON]
        path = [w for w in regex.split(r"[^\p{L}]+", found[2].lower()) if w] if found else []
        yield page_id, words, path, odds + sum(ratio.get(w, 0.0) for w in words + path)


def plain_viterbi(text, share):
    """(score, fewest words, longest last word) over all words, known or not, of any length."""
    best = [(0.0, 0, 0)]
    for end in range(1, len(text) + 1):
        best.append(max((round(best[i][0] + (math.log(share[text[i:end]]) if text[i:end] in share else math.log(1e-4) - (end - i) * math.log(26)), 7), best[i][1] - 1, -i) for i in range(end)))
    out, end = [], len(text)
    while end:
        out.append(text[-best[end][2] : end])
        end = -best[end][2]
    return out[::-1]


def test_whole_table_by_hand(spark, sf):
    got = {r.page_id: r for r in urls.op9_url_filter(spark, sf).collect()}
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    want = list(plain_filter(pages))
    assert len(got) == len(want) == len(pages)
    for page_id, words, path, score in want:
        r = got[page_id]
        assert (r.host_words, r.path_words) == (words, path) and abs(r.score - score) < 1e-6 and r.blocked == (score > 0)
    assert 0 < sum(r.blocked for r in got.values()) < 0.3 * len(got)
