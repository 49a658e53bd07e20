import random
import time

from veldra.llm import licenses

SCHEMA = "doc_id bigint, text string"


def least_edits(notice, text):
    """Fewest edits between the notice and any part of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(notice):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edit(rng, text, k):
    text = list(text)
    for _ in range(k):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[at] = rng.choice("qxz #")
        elif kind == 1 and len(text) > 1:
            del text[at]
        else:
            text.insert(at, rng.choice("qxz "))
    return "".join(text)


def test_every_notice_within_its_edits_is_found():
    rng = random.Random(1)
    scanner = licenses.Scanner()
    for _ in range(600):
        name = rng.choice(list(licenses.NOTICES))
        notice = licenses.NOTICES[name]
        k = rng.randrange(0, len(notice) // licenses.ERROR_SHARE + 4)
        text = "Some İ words before. " * rng.randrange(3) + edit(rng, notice, k) + " and some after" * rng.randrange(3)
        low = licenses.lowered(text)
        least = least_edits(licenses.lowered(notice), low)
        found = [h for h in licenses.Scanner({name: notice}).scan(text)]
        if least <= len(notice) // licenses.ERROR_SHARE:
            assert min(h[3] for h in found) == least
            hit = min(found, key=lambda h: h[3])
            assert least_edits(licenses.lowered(notice), low[hit[1] : hit[2]]) == least
            assert any(h[1] < hit[2] and hit[1] < h[2] for h in scanner.scan(text))
        else:
            assert not found


def test_least_matches_the_plain_table():
    rng = random.Random(2)
    for _ in range(300):
        notice = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("ab c") for _ in range(rng.randrange(0, 120)))
        assert licenses.Notice("x", notice, 3).least(text, 0, len(text)) == least_edits(notice, text)


def test_many_and_overlapping():
    mit, cc = licenses.NOTICES["mit"], licenses.NOTICES["cc-by-nc-4.0"]
    text = f"{mit}{mit} {mit[:-1]}\n{cc}"
    found = licenses.Scanner().scan(text)
    assert [(h[0], text[h[1] : h[2]], h[3]) for h in found if h[3] == 0] == [("cc-by-nc-4.0", cc, 0), ("mit", mit, 0), ("mit", mit, 0)]
    assert sum(h[0] == "mit" for h in found) == 3
    # The sister licence is two letters away, but what is there is the other one.
    assert not any(h[0] == "cc-by-sa-4.0" for h in found)


def test_edge_cases(spark):
    mit = licenses.NOTICES["mit"]
    far = "x" * 500_000 + mit.upper()
    rows = [(1, None), (2, ""), (3, mit), (3, mit), (None, mit), (4, far), (5, "nothing of the kind")]
    got = licenses.scan_notices(spark.createDataFrame([(*r, "y") for r in rows], SCHEMA + ", notice string")).collect()
    assert sorted((r.doc_id or 0, r.notice, r.start, r.end, r.edits) for r in got) == [(0, "mit", 0, 30, 0), (3, "mit", 0, 30, 0), (3, "mit", 0, 30, 0), (4, "mit", 500_000, 500_030, 0)]
    assert licenses.scan_notices(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table_by_plain_search(spark, sf):
    got = {(r.doc_id, r.start) for r in licenses.op5_license_scan(spark, sf).collect() if r.edits == 0}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        low = r.text.lower()
        for notice in licenses.NOTICES.values():
            at = low.find(notice.lower())
            while at >= 0:
                want.add((r.doc_id, at))
                at = low.find(notice.lower(), at + 1)
    assert want and got == want


def plain_scan(notice, text):
    """Best first by rescanning what is left, as long as anything is."""
    import regex

    k = len(notice) // licenses.ERROR_SHARE
    out, parts = [], [(0, len(text))]
    while parts:
        first, last = parts.pop()
        edits = least_edits(notice, text[first:last])
        if edits > k:
            continue
        hit = regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}").search(text, first, last)
        out.append((hit.start(), hit.end(), sum(hit.fuzzy_counts)))
        parts += [(first, hit.start()), (hit.end(), last)]
    return sorted(out)


def test_repeated_notices_by_rescanning():
    rng = random.Random(3)
    for name in ("mit", "gpl-3.0", "all-rights-reserved"):
        notice = licenses.lowered(licenses.NOTICES[name])
        scanner = licenses.Scanner({name: notice})
        for _ in range(40):
            text = "".join(edit(rng, notice, rng.choice([0, 0, 1, 1, 2, 3, 5])) + rng.choice(["", "", " ", "x", " and then "]) for _ in range(rng.randrange(1, 7)))
            assert [h[1:] for h in scanner.scan(text)] == plain_scan(notice, text)


def test_time_grows_with_the_text():
    """1 MB of one notice, exact and with edits, takes seconds, not hours."""
    mit = licenses.NOTICES["mit"]
    scanner = licenses.Scanner()
    for text, edits, limit in ((mit * 35_000, 0, 20), ((mit[:9] + "x" + mit[9:] + " ") * 30_000, 1, 60)):
        began = time.perf_counter()
        found = scanner.scan(text)
        assert time.perf_counter() - began < limit
        assert len(found) == text.count(mit[-7:]) and {h[3] for h in found} == {edits}


def test_overlaps_of_many_hits():
    rng = random.Random(4)
    for _ in range(50):
        hits = [("n", a, a + rng.randrange(1, 12), rng.randrange(4)) for a in (rng.randrange(80) for _ in range(30))]
        kept = []
        for hit in sorted(hits, key=lambda x: x[3]):
            if not any(x[3] < hit[3] and x[1] < hit[2] and hit[1] < x[2] for x in kept):
                kept.append(hit)
        assert licenses._best(hits) == sorted(kept)
