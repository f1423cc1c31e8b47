"""The operators against brute force on small fixtures, with nulls, empty and long texts, ties and repeats."""

import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from studybank.llm import chat, common, decontam, jaccard, langid, mixing, sharding, suffixes, topk, toxicity, warc
from studybank.session import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, nulls, repeated rows, a long text, self-repeating bytes."""
    common.prepare(spark)
    rng = random.Random(5)
    base = [words(rng, 120) for _ in range(6)]
    long = words(rng, 4000)
    texts = [None, "", "   ", "one two", "One, two!", "aaaa" * 200, "é" * 300, base[0], base[0], base[1],
             base[1].replace(base[1].split()[60], "zzz", 1), long, long + " " + base[2], base[2], "x " + base[3] + " y",
             base[3] + base[4], base[4][:250], base[5], base[5].upper()]
    rows = [(i, t, "en", ["a", "b", None, "é"][i % 4], 0) for i, t in enumerate(texts)]
    rows += [(None, base[0], None, None, None), (7, base[0], "en", "é", 0), (7, base[0], "en", "é", 0)]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    common.prepare(spark)
    return spark.createDataFrame([], DOCS)


def test_suffixes(docs, empty, monkeypatch):
    def brute(rows):
        raws = [(r.doc_id, (r.text or "").encode()) for r in rows]
        seen = {}
        for _, raw in raws:
            for s in range(len(raw) - 199):
                seen[raw[s:s + 200]] = seen.get(raw[s:s + 200], 0) + 1
        out = []
        for i, raw in raws:
            gone = np.zeros(len(raw), dtype=bool)
            for s in range(len(raw) - 199):
                if seen[raw[s:s + 200]] > 1:
                    gone[s:s + 200] = True
            runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
            out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
        return sorted(out, key=str)

    expected = brute(docs.collect())
    for part, piece in ((40_000, 1 << 20), (20, 700)):  # the second: several tasks, texts in pieces
        monkeypatch.setattr(suffixes, "PART", part)
        monkeypatch.setattr(suffixes, "PIECE", piece)
        got = suffixes.without_repeats(docs).drop("kept").collect()
        assert sorted(map(tuple, got), key=str) == expected
    assert suffixes.without_repeats(empty).count() == 0


def test_a_passage_of_very_many_documents_is_not_merged_by_one_task(spark, monkeypatch):
    rng = random.Random(21)
    passages = [words(rng, 90), words(rng, 120)]
    texts = [words(rng, 40) + " " + passages[i % 4 == 0] + " " + words(rng, 40) for i in range(300)]
    texts += [passages[0], "same left " + passages[0], "the same left " + passages[0] + " right", texts[0][:500], texts[5]]
    raws = [t.encode() for t in texts]
    seen = {}
    for raw in raws:
        for s in range(len(raw) - 199):
            seen[raw[s:s + 200]] = seen.get(raw[s:s + 200], 0) + 1
    expected = []
    for i, raw in enumerate(raws):
        gone = np.zeros(len(raw), dtype=bool)
        for s in range(len(raw) - 199):
            if seen[raw[s:s + 200]] > 1:
                gone[s:s + 200] = True
        expected.append((i, int(gone.sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    merged = suffixes._merged

    def bounded(splitters):
        solve = merged(splitters)

        def check(runs):
            assert sum(len(x) // 8 for x in runs["ats"]) <= 80, "too many suffixes in one task"
            return solve(runs)
        return check

    monkeypatch.setattr(suffixes, "_merged", bounded)
    monkeypatch.setattr(suffixes, "PART", 20)
    monkeypatch.setattr(suffixes, "SAMPLE", 4)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (25, 40):
        monkeypatch.setattr(suffixes, "HOT", hot, raising=False)
        got = suffixes.without_repeats(rows).collect()
        assert sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in got) == expected


def test_loser_tree():
    rng = random.Random(1)
    for k in (1, 2, 3, 7):
        rows = [[bytes(rng.choice(b"ab") for _ in range(suffixes.SPAN)) for _ in range(rng.randint(0, 9))] for _ in range(k)]
        rows = [r + r[:2] for r in rows]
        for r in rows:
            r.sort()

        def feed(r):
            for i, x in enumerate(r):
                yield (0 if not i else suffixes._common(r[i - 1], x, 0)), x

        got = list(suffixes.merge([feed(r) for r in rows]))
        keys = [x for _, _, x in got]
        assert keys == sorted(x for r in rows for x in r)
        assert [n for _, n, _ in got][1:] == [suffixes._common(a, b, 0) for a, b in zip(keys, keys[1:])]


def sets_of(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    if not w:
        return frozenset([("?", text or "")])
    return frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)])


@pytest.mark.parametrize("limit", [512, 3])
def test_jaccard(spark, docs, empty, monkeypatch, limit):
    monkeypatch.setattr(jaccard, "LIMIT", limit)
    monkeypatch.setattr(jaccard, "DEPTH", 2)
    rng = random.Random(9)
    base = words(rng, 300).split()
    near = [Row(100 + i, " ".join(base[:i] + ["q%d" % i] + base[i + 1:]), "en", "a", 0) for i in range(20)]
    both = docs.union(spark.createDataFrame(near, DOCS))
    rows = both.collect()
    sets = [sets_of(r.text) for r in rows]
    linked = [[len(a & b) / len(a | b) >= 0.8 for b in sets] for a in sets]
    root = jaccard._roots(np.array(linked))
    least = {c: min((r.doc_id for r, d in zip(rows, root) if d == c and r.doc_id is not None), default=None) for c in set(root)}
    expected = sorted(((r.doc_id, least[c], sum(m) - 1) for r, c, m in zip(rows, root, linked)), key=str)
    got = jaccard.classes(both).select("doc_id", "class_id", "links").collect()
    assert sorted(map(tuple, got), key=str) == expected
    kept = [r.doc_id for r in jaccard.keep_one(both).collect()]
    assert sorted(kept) == sorted(least.values())
    assert jaccard.classes(empty).count() == 0


def test_decontamination(spark, docs, empty):
    rng = random.Random(3)
    items = [words(rng, 40) for _ in range(4)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (None, items[0]), (8, "too short"), (7, "")],
                                  "item_id long, text string")
    w = items[1].split()
    edited = " ".join(w[:10] + ["new"] + w[11:25] + w[26:33] + ["extra", "words"] + w[33:])
    texts = [words(rng, 500) + " " + items[0] + ". " + words(rng, 300), words(rng, 20) + " " + edited, words(rng, 900),
             " ".join(items[2].split()[:10]), items[3].upper() + "\n" + items[3], None, ""]
    got = decontam.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 0), (1, 1), (4, 3)]
    by = {r.doc_id: r for r in got}
    assert by[0].score == 1.0 and (by[0].start_word, by[0].end_word) == (500, 540)
    assert 0.8 < by[1].score < 1.0
    rest = decontam.clean(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench)
    assert sorted(r.doc_id for r in rest.collect()) == [2, 3, 5, 6]
    assert decontam.contaminated(empty, bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


def smith_waterman(a, b):
    """Best local alignment's score of two word lists, cell by cell."""
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, before[j] + (2 if x == y else -1), before[j + 1] - 1, row[j] - 1))
        before, best = row, max(best, *row)
    return best


def test_decontamination_finds_every_copy_above_the_threshold(spark):
    """Edited copies, each edited in its own way, against full alignment of every document with every item."""
    rng = random.Random(12)
    lengths = [8, 8, 9, 10, 11, 12, 20, 40]
    items = [words(rng, n).split() for n in lengths]
    for x in items[4:]:  # a pair that many items and documents share
        x[2:4] = ["very", "common"]
    texts = []
    for item in items:
        n = len(item)
        copies = [[w if i % 6 != 3 else "new" for i, w in enumerate(item)],  # an edit every six words
                  [w if i % 6 != 2 else "new" for i, w in enumerate(item)],
                  [w for i, w in enumerate(item) if i % 6 != 4],
                  [w for i, w in enumerate(item) for w in ([w, "more"] if i % 2 else [w])],  # no three words in a row are left
                  item[:3] + ["new"] + item[4:],
                  item[:n // 2] + words(rng, n // 3).split() + item[n // 2:],
                  item[n // 3:], item[:n // 2]]
        for c in copies:
            texts.append(words(rng, rng.randint(0, 90)).split() + c + words(rng, rng.randint(0, 90)).split())
    texts += [words(rng, 60).split() + ["very", "common"] * 30 for _ in range(10)] + [["very"], []]
    expected = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            score = smith_waterman(item, t) / (2 * len(item))
            if score >= decontam.THRESHOLD:
                expected[d, i] = score
    assert len(expected) > 45
    rows = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(rows, bench).collect()}
    assert got == expected


def test_short_items_are_matched_whole(spark):
    rng = random.Random(14)
    items = [words(rng, n).split() for n in range(1, 8)]
    texts, expected = [], set()
    for i, item in enumerate(items):
        item[0] = f"item{i}"
        before, after = words(rng, 40).split(), words(rng, 40).split()
        for copy, whole in ((item, True), (item[:1] + ["new"] + item[1:], not i), (item[1:], False),
                            ([x.upper() + "," for x in item], True), (["new"] + item[1:], False)):
            if whole:
                expected.add((len(texts), i, 1.0, 40, 40 + len(item)))
            texts.append(" ".join(before + copy + after))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(99, "?!")], "item_id long, text string")
    assert {tuple(r) for r in decontam.contaminated(rows, bench).collect()} == expected


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 4, (1, 15)).astype(np.uint64)
        h = np.zeros((len(a) + 1, 16), dtype=int)
        for i in range(len(a)):
            for j in range(15):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[0, j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontam.align(a, b)[0][0] == h.max()


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(size=rng.integers(0, 6))]) for i in range(300)]
    rows += [(300, None), (301, [1.0, float("nan")]), (302, [float("inf")]), (303, [None]), (None, [1.0]), (5, [0.5])]
    rows += [(400 + i, [1.0, 2.0]) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    common.prepare(spark)
    ok = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in rows
          if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    expected = []
    for q in sorted({i for i, _ in ok if i % 50 == 0}):
        mine = min(e for i, e in ok if i == q)
        best = sorted((-sum(a * b for a, b in zip(mine, e)), i) for i, e in ok if i != q)[:5]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    got = topk.top_k(v, v.filter("vec_id % 50 = 0")).collect()
    assert sorted(map(tuple, got)) == expected
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_warc_round_trip(spark):
    big = "ü" * 700
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "http://c", "small"), (4, "http://d", "small"), (5, "e", None),
            (6, "f", ""), (7, "http://g", "x" * 300_000), (None, "h", big), (8, "i", "a\r\n\r\nb" * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = shared_dir(spark, "warc-test")
    warc.write_warc(pages, path)
    got = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    assert len(got) == len(rows) and all(r.verified for r in got.values())
    for i, url, html in rows:
        raw = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        revisit = html == big and i != 2
        assert (r.record_type, r.refers_to) == (("revisit", 2) if revisit else ("response", None))
        assert revisit or bytes(r.payload) == raw
    warc.write_warc(pages.limit(0), path + "-none")
    assert warc.read_warc(spark, path + "-none").count() == 0


def test_warc_reader_frames_and_verifies():
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    sha = hashlib.sha1(b"abc").hexdigest()

    def record(digest):
        return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:4>\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
                f"WARC-Block-Digest: sha1:{hashlib.sha1(body).hexdigest()}\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"

    two = gzip.compress(record(sha)) + warc.EMPTY_MEMBER + gzip.compress(record("0" * 40))
    assert [(r[0], r[1], r[6], r[7]) for r in warc.records(two)] == [(4, 3, True, b"abc"), (4, 3, False, b"abc")]
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(two[:-12]))


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    total = sum(r.size for r in rows)
    sizes = {r.source: r.source_size for r in rows}
    goal = {r.source: r.target for r in rows}
    assert sum(sizes.values()) == total and abs(sum(goal.values()) - total) < 1e-6 * total
    largest = max(r.size for r in rows)
    for s in sizes:
        assert goal[s] <= 3 * sizes[s] + 1e-6
        assert abs(sum(r.taken for r in rows if r.source == s) - goal[s]) <= 3 * largest
    assert all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mixed_documents(docs).count() == sum(r.copies for r in rows)
    assert mixing.mix(empty).count() == 0
    assert mixing.targets({"a": 1, "b": 1000}, (1, 1)) == {"a": 3.0, "b": 998.0}


def test_sharding(spark, docs, empty):
    got = sharding.place_documents(docs, 4).collect()
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted(
        (r.doc_id, len((r.text or "").encode()) + 16) for r in docs.collect() if r.doc_id is not None)
    counts = [sorted(r.slot for r in got if r.shard == s) for s in range(4)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    assert sharding.place_documents(empty, 4).count() == 0
    # row by row, clockwise: to the next node whose shard has room
    nodes = sharding.ring(spark, 5, 8)
    rng = random.Random(0)
    counts = {p: rng.randint(1, 5) for p in rng.sample(range(sharding.SLOTS), 60)}
    room = sharding.capacities(sum(counts.values()), 5)
    left, expected = list(room), []
    for p in sorted(counts):
        start = next((i for i, (q, _) in enumerate(nodes) if q >= p), 0)
        for rank in range(counts[p]):
            shard = next(nodes[(start + i) % len(nodes)][1] for i in range(len(nodes)) if left[nodes[(start + i) % len(nodes)][1]])
            expected.append((p, rank, shard, room[shard] - left[shard]))
            left[shard] -= 1
    flat = [(x["place"], r, x["shard"], x["base"] + r - x["lo"]) for x in sharding.ranges(counts, nodes, room) for r in range(x["lo"], x["hi"])]
    assert flat == expected


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"),
             (2, 1, "assistant", "no"), (3, 0, None, None), (4, 0, "user", "alone")]
    convs = chat.conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    one = convs.filter("conv_id = 1")
    two = convs.filter("conv_id = 2").withColumn("conv_id", F.lit(1).cast("long"))
    r = chat.preference_pairs(one, two).first()
    assert r.n_common == 1 and r.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert r.chosen == "<|im_start|>assistant\nyes<|im_end|>\n"
    assert r.chosen[r.chosen_spans[0].start:r.chosen_spans[0].end] == "yes<|im_end|>"
    assert r.rejected[r.rejected_spans[0].start:r.rejected_spans[0].end] == "no<|im_end|>"
    same = chat.preference_pairs(convs, convs).collect()
    assert len(same) == 4 and all(x.chosen == "" and x.rejected == "" and not x.chosen_spans for x in same)
    assert chat.preference_pairs(convs.limit(0), convs).count() == 0


def test_language(spark):
    common.prepare(spark)
    rng = random.Random(4)
    make = {"aa": "abcde", "bb": "defgh", "cc": "éüàïö"}
    rows = []
    for i in range(600):
        lang = rng.choice(list(make))
        rows.append((i, " ".join("".join(rng.choice(make[lang]) for _ in range(5)) for _ in range(rng.randint(3, 40))), lang))
    rows += [(1000, None, "aa"), (1001, "12 !?", "bb"), (1002, "", None), (None, rows[0][1], None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {i: lang for i, _, lang in rows[:600]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"}
    none = langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)


def test_bloom_filter_counts_match_plain_sets():
    rng = random.Random(6)
    texts = [words(rng, 20) for _ in range(30)] + ["", None, "a"]
    grams = {k: np.unique(np.concatenate([langid._grams(langid._codes([t])[0], n) for t in texts[i::3] for n in langid.SIZES]))
             for i, k in enumerate("xyz")}
    f = langid.Filters(grams)
    share = f.shares(texts)
    for i, t in enumerate(texts[:30]):
        own = np.concatenate([langid._grams(langid._codes([t])[0], n) for n in langid.SIZES])
        for j, k in enumerate("xyz"):
            assert abs(share[i, j] - np.isin(own, grams[k]).mean()) < 0.02


def test_toxicity(spark):
    common.prepare(spark)
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        text = words(rng, rng.randint(10, 120)).split()
        if bad:
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(["rotter", "knave", "churl", "kn4ve"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(5000, None), (5001, ""), (None, "knave knave")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old"))
    lab = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(d, lab).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 5000]
    assert len(held) > 200 and np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in held]) > 0.97
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    constant = toxicity.toxicity(d.limit(3), lab.limit(0)).collect()
    assert [r.score for r in constant] == [0.0] * 3


def test_isotonic_is_monotone_and_pools():
    x, y = toxicity.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert list(x) == [0, 0, 1, 2, 3, 3] and list(y) == [0, 0, 0.5, 0.5, 1, 1]


def test_a_language_with_one_document_is_learned(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 60), "en") for i in range(40)]
    rows += [(100 + i, "zu ui zzu uiz " * 20, "zz" if i == learned else None) for learned in [next(
        i for i in range(60) if zlib.crc32(str(100 + i).encode()) % 4 != 2)] for i in range(60)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {got[i] for i in range(100, 160)} == {"zz"} and {got[i] for i in range(40)} == {"en"}


def test_one_id_on_very_many_rows_of_language_and_toxicity(spark):
    """A null or repeated id on most rows: what is learned from stays bounded, every row gets a result."""
    rng = random.Random(16)
    rows = [(i, words(rng, 20), "en") for i in range(60)] + [(None, words(rng, 5), "en") for _ in range(2000)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} == {"en"}
    docs = spark.createDataFrame([(i % 60 if i > 300 else i, words(rng, 8)) for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(4, 0)] * 500, "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels)
    assert out.count() == 3000 and out.filter("score between 0 and 1").count() == 3000
    model = toxicity.learn(docs, labels, sample=50)
    assert model is not None


def test_two_texts_of_one_hash(spark, monkeypatch):
    """A first hash that all texts share: they are told apart by the next ones."""
    real = suffixes._hash
    monkeypatch.setattr(suffixes, "_hash", lambda text, seed: F.lit(1).cast("long") if seed == 0 else real(text, seed))
    rng = random.Random(2)
    one = words(rng, 80)
    rows = spark.createDataFrame([(1, one), (2, one + " x"), (3, words(rng, 90)), (4, "short")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffixes.without_repeats(rows).collect()}
    assert got == {1: len(one), 2: len(one), 3: 0, 4: 0}


def test_the_cut_of_a_mix_is_found_in_ever_smaller_ranges(docs, monkeypatch):
    whole = sorted(map(str, mixing.mix(docs).collect()))
    for edge, ranges in ((1, 4), (1, 1024), (0, 2)):
        monkeypatch.setattr(mixing, "EDGE", edge)
        monkeypatch.setattr(mixing, "RANGES", ranges)
        assert sorted(map(str, mixing.mix(docs).collect())) == whole


def test_copies_of_one_key_are_dealt_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 7)
    rows = [(5, "same")] * 400 + [(i, "x") for i in range(200)]
    got = sharding.place_documents(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()
    assert len(got) == 600
    for s in range(6):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(100))


def test_names_of_inner_columns_may_occur_in_the_input(docs):
    """Extra columns named like anything the operators use inside; results are the same without them."""
    names = ["until", "full", "_src", "src", "row", "key", "of", "size", "copies_", "_md5", "md5", "digest", "id", "sig", "h", "k", "n", "e", "v", "r",
             "sid", "_copy", "copy", "place", "lo", "hi", "first", "last", "shard", "part", "lang_", "_p", "tid", "spans", "c", "g", "rank", "words"]
    rows = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    wide = rows.selectExpr("*", *[f"'x' AS `{n}`" for n in names])
    plain = ["doc_id", "text", "lang", "source", "n_chars"]

    def same(of, *columns):
        a, b = (sorted(str(tuple(r)) for r in of(x).select(*columns).collect()) for x in (rows, wide))
        assert a == b and a

    same(mixing.mix, "doc_id", "source_size", "target", "copies", "taken")
    same(mixing.mixed_documents, *plain)
    assert mixing.mixed_documents(wide).columns == wide.columns
    same(jaccard.keep_one, *plain)
    assert jaccard.keep_one(wide).columns == wide.columns
    same(lambda d: sharding.place_documents(d, 3), "doc_id", "shard", "slot")
    same(langid.identify, "doc_id", "lang_pred", "score")
    same(suffixes.without_repeats, "doc_id", "kept_sha256")
    items = rows.sparkSession.createDataFrame([(1, "two words of no text at all, and some more of them")], "item_id long, text string")
    same(lambda d: decontam.clean(d, items), *plain)


def test_large_groups_of_near_copies_are_settled_by_leaders(spark, monkeypatch):
    """Groups far over a path's limit, loosely and closely alike, and texts between them: no link is lost."""
    monkeypatch.setattr(jaccard, "LIMIT", 24)
    monkeypatch.setattr(jaccard, "LEADERS", 6)
    monkeypatch.setattr(jaccard, "BLOCK", 50)
    rng = random.Random(12)
    texts = []
    for edits in (1, 2, 4):
        base = words(rng, 90).split()
        for _ in range(120):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = words(rng, 1) + "q"
            texts.append(" ".join(own))
    common_part = words(rng, 60)  # texts that share much, but not enough
    texts += [common_part + " " + words(rng, 60) for _ in range(80)]

    def shingles(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for t in texts]
    linked = [[i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard.classes(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    root = jaccard._roots(np.array(linked))
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    assert {i: c for i, (c, _) in got.items()} == {i: least[r] for i, r in enumerate(root)}
    assert {i: n for i, (_, n) in got.items()} == {i: sum(row) for i, row in enumerate(linked)}
