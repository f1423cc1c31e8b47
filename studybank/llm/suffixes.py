"""Removal of repeated byte strings by a distributed sort of suffixes.

A string of SPAN bytes is found at its anchor: the place, among the WINDOW first ones of the string, whose next
GRAM bytes have the least hash.  Equal strings have their anchors at equal offsets, so
only suffixes at anchors are sorted, about two in WINDOW.  Anchors whose next CORE bytes occur
once can't matter and are left out first; anchors whose whole surroundings repeat are
settled by counting.  Where one core has very many surroundings, which no splitter could cut, every string of it is
counted by its hash.  The suffixes of the rest are sorted in runs, cut by sampled splitters and exchanged
front-coded; loser trees that keep the common prefix of every loser with its winner merge
them without comparing known prefixes again.  The merged order and its common prefixes tell which strings repeat.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studybank.llm.common import _MIX, byte_size, mix64, stored

SPAN, WINDOW, GRAM = 200, 150, 16
#: Bytes after an anchor that every string of it holds; bytes around an anchor that its strings can hold.
CORE, LEFT = SPAN - WINDOW + 1, WINDOW - 1
#: Bytes of text worked on at a time; starts of one piece of a long text.
PIECE = 1 << 20
#: Suffixes of one run, suffixes merged by one task, suffixes sampled for the splitters: at least, and for each part.
RUN, PART, SAMPLE, PER_PART = 100_000, 40_000, 4096, 16
#: Most suffixes of one core that are merged; those of others are counted, in runs of so many.
HOT, HOT_RUN = 2000, 4000
#: Texts whose numbers are broadcast to find them (8 bytes each); more are found by a shuffle.
FEW = 200_000
#: Fills a suffix up at the end of its text; no byte of UTF-8.
PAD = 0xFF

_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _MIX)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, mod 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 21)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def _pieces(raws: list[bytes]):
    """Groups of (text number, offset, bytes, first start, end of starts) of about PIECE bytes in all.

    A piece has the bytes around its starts that anchors and their surroundings need."""
    group, size = [], 0
    for d, raw in enumerate(raws):
        for u in range(0, len(raw) - SPAN + 1, PIECE):
            lo, stop = max(0, u - 2 * WINDOW), min(u + PIECE, len(raw) - SPAN + 1)
            part = raw[lo:stop + SPAN + 3 * WINDOW]
            group.append((d, lo, part, u - lo, stop - lo))
            size += len(part)
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def _least(joined: bytes, n: int) -> np.ndarray:
    """Anchor of the string at each of the n first places."""
    loads = np.ndarray((len(joined) - 7,), dtype="<u8", buffer=joined, strides=(1,))
    out, step, low = np.empty(n, dtype=np.int64), 1 << 16, np.uint64((1 << 18) - 1)
    for lo in range(0, n, step):
        m = min(step, n - lo) + WINDOW
        with np.errstate(over="ignore"):
            h = loads[lo:lo + m] * _MIX
            h ^= loads[lo + 8:lo + 8 + m] * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        # the place breaks ties: the first of equal hashes is the least
        h &= ~low
        h |= np.arange(m, dtype=np.uint64)
        width = 1
        while 2 * width <= WINDOW:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        h = np.minimum(h[:len(h) - (WINDOW - width)], h[WINDOW - width:])
        out[lo:lo + step] = (h[:min(step, n - lo)] & low).astype(np.int64) + lo
    return out


def anchors(raws: list[bytes]):
    """Anchors of the strings of SPAN bytes of some texts.

    Yields arrays: text number, place, least and greatest offset of a string's start before the
    place, hash of the core, hash of the surroundings (with where the text cuts them)."""
    for group in _pieces(raws):
        joined = b"".join(g[2] for g in group)
        sizes = np.array([len(g[2]) for g in group], dtype=np.int64)
        base = np.cumsum(sizes) - sizes
        n = len(joined)
        at = _least(joined + b"\0" * (WINDOW + GRAM + 8), n)
        valid = np.zeros(n, dtype=bool)
        for (d, lo, part, first, stop), b in zip(group, base):
            # anchors that begin before the piece are found, then left out
            valid[b + max(0, first - WINDOW):b + min(stop + WINDOW, len(part) - SPAN + 1)] = True
        s = np.flatnonzero(valid)
        a = at[s]
        # an anchor's starts are consecutive; equal places are one anchor
        new = np.concatenate(([True], a[1:] != a[:-1]))
        begin = np.flatnonzero(new)
        p, s_lo, s_hi = a[begin], s[begin], s[np.concatenate((begin[1:], [len(s)])) - 1]
        piece = np.searchsorted(base, p, side="right") - 1
        first = np.array([g[3] for g in group])[piece] + base[piece]
        stop = np.array([g[4] for g in group])[piece] + base[piece]
        own = (s_lo >= first) & (s_lo < stop)
        p, s_lo, s_hi, piece = p[own], s_lo[own], s_hi[own], piece[own]
        power, inverse = _powers(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE[np.frombuffer(joined, dtype=np.uint8)] * power[:n], out=total[1:])
            start = np.maximum(p - LEFT, base[piece])
            end = np.minimum(p + SPAN, base[piece] + sizes[piece])
            core = mix64((total[p + CORE] - total[p]) * inverse[p])
            cut = ((p - start) * 1024 + (end - p)).astype(np.uint64)
            around = mix64((total[end] - total[start]) * inverse[start] + cut * _MIX)
        offset = np.array([g[1] for g in group], dtype=np.int64)[piece] - base[piece]
        yield np.array([g[0] for g in group])[piece], p + offset, p - s_hi, p - s_lo, core, around


def _raw(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _cores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for _, _, _, _, core, _ in anchors([_raw(t) for t in b["text"]]):
            core = np.sort(core.view(np.int64))
            first = np.flatnonzero(np.concatenate(([True], core[1:] != core[:-1]))) if len(core) else core
            yield pd.DataFrame({"core": core[first], "n": np.diff(np.concatenate((first, [len(core)])))})


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        tid = b["tid"].to_numpy()
        for doc, p, low, high, core, around in anchors([_raw(t) for t in b["text"]]):
            yield pd.DataFrame({"core": core.view(np.int64), "around": around.view(np.int64), "tid": tid[doc],
                                "at": p << 16 | high << 8 | low})


def _sides(raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchor: the SPAN bytes from it on, filled up with PAD, and the LEFT bytes before it, backwards."""
    data = np.frombuffer(raw, dtype=np.uint8)
    right = at[:, None] + np.arange(SPAN)
    left = at[:, None] - 1 - np.arange(LEFT)
    return (np.where(right < len(data), data[np.minimum(right, len(data) - 1)], np.uint8(PAD)),
            np.where(left >= 0, data[np.maximum(left, 0)], np.uint8(PAD)))


# A run: suffixes in order, front-coded.  Each is the number of bytes it shares with the one before and the bytes after those.

def _sort_run(right: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(right).view(f"V{SPAN}").ravel(), kind="stable")


def _shared(right: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before (0 for the first)."""
    differ = right[1:] != right[:-1]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), SPAN)
    return np.concatenate(([0], n)).astype(np.uint8)


def _runs(splitters: list[bytes]):
    """Runs of the suffixes at ``ats``; those of hot cores (complements, below 0) are part -1."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bool, list[tuple]] = {False: [], True: []}
        count = {False: 0, True: 0}

        def cut(hot: bool) -> pd.DataFrame:
            out = _cut(held[hot], []).assign(part=-1) if hot else _cut(held[hot], splitters)
            held[hot], count[hot] = [], 0
            return out

        for b in batches:
            for tid, text, ats in zip(b["tid"], b["text"], b["ats"]):
                ats = np.asarray(ats, dtype=np.int64)
                for hot, packed, size in ((False, np.sort(ats[ats >= 0]), RUN), (True, np.sort(~ats[ats < 0]), HOT_RUN)):
                    for lo in range(0, len(packed), size):
                        some = packed[lo:lo + size]
                        held[hot].append((np.full(len(some), tid), some, *_sides(_raw(text), some >> 16)))
                        count[hot] += len(some)
                        if count[hot] >= size:
                            yield cut(hot)
        for hot in held:
            if held[hot]:
                yield cut(hot)
    return write


def _cut(held: list[tuple], splitters: list[bytes]) -> pd.DataFrame:
    """One sorted run, cut where the splitters fall; a part is one row."""
    tid, at, right, left = (np.concatenate(x) for x in zip(*held))
    order = _sort_run(right)
    tid, at, right, left = tid[order], at[order], right[order], left[order]
    keys = [r.tobytes() for r in right] if splitters else []
    cuts = [0, *(bisect_left(keys, s) for s in splitters), len(tid)]
    rows = []
    for part, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        if lo < hi:
            shared = _shared(right[lo:hi])
            tails = right[lo:hi][np.arange(SPAN) >= shared[:, None]]
            high = (at[lo:hi] >> 8) & 255
            lefts = left[lo:hi][np.arange(LEFT) < high[:, None]]
            rows.append((part, shared.tobytes(), tails.tobytes(), lefts.tobytes(), tid[lo:hi].tobytes(), at[lo:hi].tobytes()))
    return pd.DataFrame(rows, columns=["part", "shared", "tails", "lefts", "tids", "ats"])


RUN_SCHEMA = "part int, shared binary, tails binary, lefts binary, tids binary, ats binary"


def _suffixes(shared: bytes, tails: bytes) -> Iterator[tuple[int, bytes]]:
    """A run's suffixes in order, with what each shares with the one before."""
    key, i = b"", 0
    for n in shared:
        j = i + SPAN - n
        key, i = key[:n] + tails[i:j], j
        yield n, key


def _common(a: bytes, b: bytes, n: int) -> int:
    """Common prefix of a and b, of which n bytes are known."""
    while n < SPAN and a[n:n + 16] == b[n:n + 16]:
        n += 16
    if n >= SPAN:
        return SPAN
    while a[n] == b[n]:
        n += 1
    return n


def merge(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """Merge sorted runs of (shared with the one before, suffix): yields (run, shared with the last one out, suffix).

    A loser tree.  Each node keeps the loser of its match and how much that loser shares with the
    winner.  Both sides of a later match then know what they share with the last suffix put out: the one
    that shares more comes first, and only if they share the same are bytes compared, from there on."""
    k = 1
    while k < len(runs):
        k *= 2
    feeds = list(runs) + [iter(())] * (k - len(runs))
    keys: list[bytes | None] = [None] * k
    know = [0] * k
    for i, feed in enumerate(feeds):
        _, keys[i] = next(feed, (0, None))

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets what the loser shares with the winner."""
        if keys[a] is None or keys[b] is None:
            return (b, a) if keys[a] is None else (a, b)
        if know[a] != know[b]:
            return (a, b) if know[a] > know[b] else (b, a)
        n = _common(keys[a], keys[b], know[a])
        if n < SPAN and keys[a][n] > keys[b][n]:
            a, b = b, a
        know[b] = n
        return a, b

    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = match(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    while keys[top] is not None:
        yield top, know[top], keys[top]
        know[top], keys[top] = next(feeds[top], (0, None))
        node = (top + k) // 2
        while node:
            top, losers[node] = match(top, losers[node])
            node //= 2


def repeated(lcp: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which strings of sorted suffixes repeat: a matrix of suffix by offset.

    ``lcp`` is each suffix's common prefix with the one before, ``left`` the bytes before, backwards.  The
    string that starts j bytes before the suffix repeats if another suffix shares SPAN - j bytes with it
    and the same j bytes stand before both."""
    out = np.zeros((len(lcp), WINDOW), dtype=bool)
    hashes = np.zeros(len(lcp), dtype=np.uint64)
    before = np.ascontiguousarray(left.T)
    after = np.concatenate((lcp[1:], [0]))
    near = np.maximum(lcp, after)
    for j in range(WINDOW):
        if j:
            with np.errstate(over="ignore"):
                hashes = hashes * np.uint64(_BASE) + _BYTE[before[j - 1]]
        some = np.flatnonzero((low <= j) & (j <= high) & (near >= SPAN - j))
        if len(some) < 2:
            continue
        group = np.cumsum(lcp < SPAN - j).astype(np.uint64)
        with np.errstate(over="ignore"):
            key = mix64(hashes[some] ^ mix64(group[some] * _MIX))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
        out[some[order[twice]], j] = True
    return out


STRINGS = ["tid", "a", "b", "h", "g"]


def _strings(tid: int, at: int, left: bytes, key: bytes) -> Iterator[tuple]:
    """The strings of a suffix with the bytes before it, as rows of STRINGS, told apart by their md5."""
    p, high, low = at >> 16, (at >> 8) & 255, at & 255
    text = left[:high][::-1] + key
    for j in range(low, high + 1):
        digest = hashlib.md5(text[high - j:high - j + SPAN]).digest()
        yield (tid, p - j, p - j + SPAN,
               int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The strings of runs of hot cores: those that repeat within a run as intervals (h null), and each
    different one once, with its number in the run."""
    for b in batches:
        for shared, tails, lefts, tids, ats in zip(b["shared"], b["tails"], b["lefts"], b["tids"], b["ats"]):
            rows: list[tuple] = []
            begin = 0
            some = zip(np.frombuffer(tids, np.int64).tolist(), np.frombuffer(ats, np.int64).tolist(), _suffixes(shared, tails))
            for tid, at, (_, key) in some:
                end = begin + ((at >> 8) & 255)
                rows.extend(_strings(tid, at, lefts[begin:end], key))
                begin = end
            all_ = pd.DataFrame(rows, columns=STRINGS)
            all_["n"] = all_.groupby(["h", "g"])["a"].transform("size")
            met = all_[all_["n"] > 1].sort_values(["tid", "a"])
            new = ((met["tid"] != met["tid"].shift()) | (met["a"] != met["a"].shift() + 1)).cumsum()
            found = met.groupby(new).agg(tid=("tid", "first"), a=("a", "first"), b=("b", "last"))
            both = pd.concat([found.assign(h=None, g=None, n=None), all_.drop_duplicates(["h", "g"])])
            yield both.astype({"tid": "int64", "a": "int64", "b": "int64", "h": "Int64", "g": "Int64", "n": "Int64"})


def _merged(splitters: list[bytes]):
    def solve(runs: pd.DataFrame) -> pd.DataFrame:
        part = int(runs["part"].iloc[0])
        runs = runs.sort_values(["tids", "ats"])
        tid = [np.frombuffer(x, np.int64) for x in runs["tids"]]
        at = [np.frombuffer(x, np.int64) for x in runs["ats"]]
        left = []
        for x, a in zip(runs["lefts"], at):
            m = np.full((len(a), LEFT), PAD, dtype=np.uint8)
            m[np.arange(LEFT) < ((a >> 8) & 255)[:, None]] = np.frombuffer(x, np.uint8)
            left.append(m)
        n = sum(map(len, tid))
        source, lcp = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        edges = [s[:CORE] for s in splitters[max(0, part - 1):part + 1]]
        crossing: list[tuple[int, bytes]] = []
        for i, (run, shared, key) in enumerate(merge([_suffixes(a, b) for a, b in zip(runs["shared"], runs["tails"])])):
            source[i], lcp[i] = run, shared
            if key[:CORE] in edges:
                crossing.append((i, key))
        # a run's suffixes come out in its own order
        order = np.argsort(source, kind="stable")
        tid, at, left = (np.concatenate(x) for x in (tid, at, left))
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        tid, at, left = tid[place], at[place], left[place]
        p, high, low = at >> 16, (at >> 8) & 255, at & 255
        hit = repeated(lcp, left, low, high)
        row, j = np.nonzero(hit)
        s = p[row] - j
        # runs of neighbouring starts become one interval
        if len(s):
            go = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (s[1:] != s[:-1] - 1))))
            last = np.concatenate((go[1:], [len(s)])) - 1
            found = pd.DataFrame({"tid": tid[row[go]], "a": s[last], "b": s[go] + SPAN, "h": None, "g": None})
        else:
            found = pd.DataFrame({"tid": [], "a": [], "b": [], "h": [], "g": []})
        rows = [x for i, key in crossing for x in _strings(int(tid[i]), int(at[i]), left[i].tobytes(), key)]
        both = pd.concat([found, pd.DataFrame(rows, columns=STRINGS)]) if rows else found
        return both.astype({"tid": "int64", "a": "int64", "b": "int64", "h": "Int64", "g": "Int64"})
    return solve


def _remove(texts: bool):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _removed(b, texts)
    return cut


def _removed(b: pd.DataFrame, texts: bool) -> pd.DataFrame:
    rows = []
    for tid, text, spans in zip(b["tid"], b["text"], b["spans"]):
        raw, keep, end, removed, runs = _raw(text), [], 0, 0, 0
        for lo, hi in sorted((x["a"], x["b"]) for x in spans):
            if lo > end or not runs:
                keep.append(raw[end:lo])
                runs += 1
                end = lo
            if hi > end:
                removed += hi - end
                end = hi
        keep.append(raw[end:])
        kept = b"".join(keep)
        rows.append((tid, removed, runs, hashlib.sha256(kept).hexdigest(),
                     kept.decode("utf-8", "replace") if texts else None))
    return pd.DataFrame(rows, columns=["tid", "n_removed", "n_spans", "kept_sha256", "kept"])


def _hash(text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(text, F.lit("")))


def _clashes(docs: DataFrame) -> list[int]:
    """First hashes that two different texts share, told by a second hash: n^2 / 2^65 of them are to be expected of n texts."""
    both = docs.filter(F.octet_length("text") >= SPAN).select(_hash(F.col("text"), 0).alias("h"), _hash(F.col("text"), 1).alias("c"))
    rows = both.groupBy("h").agg(F.min("c").alias("c"), F.max("c").alias("d")).filter("c <> d").select("h").collect()
    return sorted(r["h"] for r in rows)


def _tid(text: Column, clashes: list[int]) -> Column:
    """Number of a text: its first hash, or its third where the first is shared."""
    return F.when(_hash(text, 0).isin(clashes), _hash(text, 2)).otherwise(_hash(text, 0)) if clashes else _hash(text, 0)


def _texts(docs: DataFrame, clashes: list[int]) -> DataFrame:
    """One row for each different text: tid, text.  Two texts of one number raise an error; as clashes are
    numbered anew, that takes texts that share two hashes."""
    t = (docs.select(_tid(F.col("text"), clashes).alias("tid"), _hash(F.col("text"), 1).alias("c"), "text").groupBy("tid")
         .agg(F.first("text").alias("text"), F.min("c").alias("c"), F.max("c").alias("d")))
    return t.select("tid", F.when(F.col("c") != F.col("d"), F.raise_error(F.lit("two texts have one number")).cast("string"))
                    .otherwise(F.col("text")).alias("text"))


def _texts_of(docs: DataFrame, clashes: list[int], wanted: DataFrame) -> DataFrame:
    """``_texts`` of the tids that ``wanted`` (one row a tid) has, joined to it.  Unless very many are wanted, no other text is
    shuffled."""
    ids = wanted.select("tid")
    if wanted.count() <= FEW:
        tid = _tid(F.col("text"), clashes)
        docs = docs.select("text", tid.alias("tid")).join(F.broadcast(ids), "tid", "left_semi")
    return _texts(docs, clashes).join(wanted, "tid")


def intervals(docs: DataFrame, clashes: list[int]) -> DataFrame:
    """(tid, a, b): byte intervals of texts that are covered by repeated strings; they may overlap."""
    long = docs.select(_tid(F.col("text"), clashes).alias("tid"), "text").filter(F.octet_length("text") >= SPAN)
    cores = stored(long.select("text").mapInPandas(_cores, "core long, n long").groupBy("core")
                   .agg(F.sum("n").alias("n")).filter("n > 1").select("core"), "suffix-cores")
    met = stored(long.mapInPandas(_placed, "core long, around long, tid long, at long").join(cores, "core"), "suffix-met")
    kinds = stored(met.groupBy("core", "around").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("tid", "at")).alias("one")), "suffix-kinds")
    several = stored(kinds.filter("n > 1").select("core", "around"), "suffix-several")
    sure = met.join(several, ["core", "around"]).select("tid", "at").distinct()
    a, b = F.expr("shiftright(at, 16) - (shiftright(at, 8) & 255)"), F.expr(f"shiftright(at, 16) - (at & 255) + {SPAN}")
    sure = sure.select("tid", a.alias("a"), b.alias("b"))
    # one suffix for each kind of surroundings, where kinds of one core differ and one of them is single
    open_ = stored(kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
                   .filter("kinds > 1 and least = 1").select("core", (F.col("kinds") > HOT).alias("hot")), "suffix-open")
    chosen = stored(kinds.join(open_, "core").select("one.tid", "one.at", "hot"), "suffix-chosen")
    calm = chosen.filter("not hot")
    sizes = {r["hot"]: r["count"] for r in chosen.groupBy("hot").count().collect()}
    parts = -(-sizes.get(False, 0) // PART)
    splitters: list[bytes] = []
    if parts > 1:
        every = max(1, sizes[False] // max(SAMPLE, PER_PART * parts))
        sample = F.broadcast(calm.filter(F.pmod(F.xxhash64("tid", "at"), F.lit(every)) == 0).select("tid", "at"))
        at = F.shiftright("at", 16)
        raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
        got = (long.join(sample, "tid").select("tid", "at", F.substring(raw, at.cast("int") + 1, F.lit(SPAN)).alias("k")).distinct().collect())
        keys = sorted(bytes(r["k"]).ljust(SPAN, bytes([PAD])) for r in got)
        splitters = sorted({keys[len(keys) * i // parts] for i in range(1, parts)})
    per_text = stored(chosen.groupBy("tid").agg(
        F.collect_list(F.when(F.col("hot"), F.bitwise_not("at")).otherwise(F.col("at"))).alias("ats")), "suffix-ats")
    runs = _texts_of(long, clashes, per_text).select("tid", "text", "ats").mapInPandas(_runs(splitters), RUN_SCHEMA)
    if True in sizes:
        runs = stored(runs, "suffix-runs")
    solved = stored(runs.filter("part >= 0").groupBy("part").applyInPandas(
        _merged(splitters), "tid long, a long, b long, h long, g long"), "suffix-solved")
    found = sure.union(solved.filter("h is null").select("tid", "a", "b"))
    # strings of a hot core, and of one that falls on a splitter, are counted whole
    counted = []
    if True in sizes:
        strings = stored(runs.filter("part < 0").mapInPandas(_counted, "tid long, a long, b long, h long, g long, n long"),
                         "suffix-strings")
        found = found.union(strings.filter("h is null").select("tid", "a", "b"))
        counted.append(strings.filter("h is not null"))
    if splitters:
        counted.append(solved.filter("h is not null").withColumn("n", F.lit(1).cast("long")))
    for whole in counted:
        twice = stored(whole.groupBy("h", "g").agg(F.sum("n").alias("n")).filter("n > 1").select("h", "g"), "suffix-crossing")
        found = found.union(whole.filter("n = 1").join(twice, ["h", "g"]).select("tid", "a", "b"))
    return found.distinct()


def without_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) without the bytes that a repeated string of SPAN bytes covers.

    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes left) and kept
    (those bytes as text; a character cut in half becomes the replacement character; null where
    nothing was removed, and without ``texts``).  Strings are UTF-8 bytes and are judged on the input; they never cross texts.  Null text
    is empty; copies of a text of SPAN bytes or more lose all of it, repeated rows too.  Other columns are ignored."""
    clashes = _clashes(docs)
    spans = stored(intervals(docs, clashes).groupBy("tid").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "suffix-spans")
    long = docs.filter(F.octet_length("text") >= SPAN)
    cut = _texts_of(long, clashes, spans).select("tid", "text", "spans").mapInPandas(
        _remove(texts), "tid long, n_removed long, n_spans long, kept_sha256 string, kept string")
    cut = stored(cut, "suffix-cut")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", _tid(F.col("text"), clashes).alias("tid"), byte_size(F.col("text")).alias("n_bytes"),
                       F.sha2(raw, 256).alias("whole"))
    none = F.lit(0).cast("long")
    return rows.join(cut, "tid", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"), "kept")
