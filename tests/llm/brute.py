"""The contracts in plain Python over lists of (doc_id, text, source): what the Spark operators must give."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def fingerprint(text: str | None, width: int = 4) -> int:
    own = words(lower(text or ""))
    if not own:
        return 0
    shingles = [" ".join(own[i : i + width]) for i in range(max(1, len(own) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: list[int], bits: int = 4) -> list[int]:
    """For each row the number of its component's first row."""
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def simhash(rows) -> list[tuple]:
    fps = [fingerprint(t) for _, t, _ in rows]
    roots = components(fps)
    least = defaultdict(list)
    for (doc_id, _, _), r in zip(rows, roots, strict=True):
        if doc_id is not None:
            least[r].append(doc_id)
    return [(d, f"{f:016x}", min(least[r], default=None)) for (d, _, _), f, r in zip(rows, fps, roots, strict=True)]


def rules(text: str | None) -> tuple:
    own = words(text)
    windows = Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
    covered = {i + k for i in range(len(own) - 7) if windows[tuple(own[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(own) < 20 or 100 * len(covered) > 30 * len(own)
    return (
        len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed,
    )


def substring(rows, width: int = 50) -> list[tuple]:
    least: dict = {}
    for doc_id, text, _ in rows:
        own = words(text)
        for i in range(len(own) - width + 1):
            key = tuple(own[i : i + width])
            least[key] = min(least.get(key, (True, 0)), order(doc_id))
    out = []
    for doc_id, text, _ in rows:
        own = words(text)
        gone = set()
        for i in range(len(own) - width + 1):
            if least[tuple(own[i : i + width])] < order(doc_id):
                gone |= set(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out.append((doc_id, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def targets(sizes: dict, weights=(5, 2, 1), budget: float = 1.5, epochs: int = 2) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = budget * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= epochs * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = epochs * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def token_rows(rows, tokenizer, end: int = 2) -> list[tuple]:
    out, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: order(r[0])):
        ids = [*(tokenizer.encode(text, add_special_tokens=False).ids if text else []), end]
        out.append((doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def runs(words: list) -> list[tuple]:
    """(start, length, period) of the runs of six words and four periods at least, by start, then period."""
    found: dict = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)  # a smaller period has the same stretch
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def planted_words(doc_id, text: str | None) -> list[str]:
    own = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and own:
        g, n = h // 10, len(own)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = own[:a] + [own[a + (i - a) % p] for i in range(a, n)]
    return own


def run_rows(rows) -> list[tuple]:
    out = []
    for doc_id, text, _ in rows:
        own = planted_words(doc_id, text)
        found = runs(own)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out.append(
            (doc_id, len(own), len(found), *best, 1000 * best[1] // best[2] if found else None,
             hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
        )
    return out


def aligned(text: str | None, a, b) -> tuple[list, list, list, list]:
    """A's and B's ids of one text, its groups (two slices each) and its links, by comparing all byte ranges."""
    table = byte_level()
    if not text:
        return [], [], [], []
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    b_ids = b.encode(text)
    a_bytes = [bytes(table[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in b_ids]
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return [], [], [], []

    def spans(parts):
        out, at = [], 0
        for x in parts:
            out.append((at, at + len(x)))
            at += len(x)
        return out

    a_spans, b_spans = spans(a_bytes), spans(b_bytes)
    groups, low = [], 0
    for end in sorted({e for _, e in a_spans} & {e for _, e in b_spans}):
        inside = lambda own, ids: [i for (s, e), i in zip(own, ids, strict=True) if low <= s and e <= end]  # noqa: B023, E731
        groups.append((inside(a_spans, a_ids), inside(b_spans, b_ids)))
        low = end
    links = [
        (a_ids[i], b_ids[j])
        for i, (s, e) in enumerate(a_spans)
        for j, (t, f) in enumerate(b_spans)
        if max(s, t) < min(e, f)
    ]
    return a_ids, b_ids, groups, links


def byte_level() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}


def alignment_rows(rows, a, b) -> list[tuple]:
    found = [(d, *aligned(t, a, b)) for d, t, _ in rows]
    counts = Counter(link for *_, links in found for link in links)
    highest: dict = {}
    for (_, y), n in counts.items():
        highest[y] = max(highest.get(y, 0), n)
    out = []
    for doc_id, a_ids, b_ids, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (doc_id, len(a_ids), len(b_ids), len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links),
             sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a_ids else "")
        )
    return out
