"""Personal data in whole texts: fixed patterns, and a semi-Markov conditional random field for the rest.

Patterns find the base spans: email addresses, IP addresses, payment cards, phone numbers. What they
leave open, numbers in national form, spelled-out addresses, account numbers, is decided by a model
over whole segments: a segment is a run of neighbouring pieces of a candidate, and features of the whole
segment (digits, check sums, separators, cue words before it, what touches it) score it for each kind.
Dynamic programming over the pieces picks boundaries and kinds together. A segment has ``MOST_PIECES``
pieces at most; base spans are barriers that no segment crosses, so all of them stay.

The weights start from a prior and are learned by gradient steps on the semi-Markov likelihood (sums over all
segmentations) from a sample, ``TRAIN_DOCS`` texts with digits or at signs in the order of a hash of their ids, with
all their candidates. Spans the patterns accept are segments; what fails a check sum or a range is no card or IP
address; everything else is unlabelled and teaches nothing, so the field is not trained against what it adds.

A null text is an empty one. Rows are mapped one by one: repeated rows repeat. No rows: no rows, and the
prior weights.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlake.llm.common import keyed_text, map_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")
#: Texts the weights are learned from at most, and characters read around each candidate there.
TRAIN_DOCS, TRAIN_REACH, EPOCHS = 2000, 80, 5
#: Length of a gradient step, and how strongly the weights are drawn to the prior.
STEP, RIDGE = 0.1, 0.1
MOST_PIECES = 8
#: Characters of a run of numbers that is a candidate.
LEAST_RUN = 7
#: Kinds a candidate of each shape can be.
SHAPES = {"number": ("ip", "card", "phone"), "account": ("iban",), "spelled": ("email",), "address": ("email",)}
#: Weights before learning; shapes that the patterns never accept keep these.
PRIOR = {
    ("email", "bias"): -1.0, ("email", "shape=address"): 3.0, ("email", "shape=spelled"): 2.0,
    ("ip", "bias"): -4.0, ("ip", "quad in range"): 5.0, ("card", "bias"): -4.0, ("card", "luhn"): 5.0,
    ("phone", "bias"): -3.5, ("phone", "first=+"): 4.0, ("phone", "first=("): 1.0, ("phone", "cue phone"): 2.5,
    **{("phone", f"digits={n}"): 1.5 for n in range(9, 16)},
    ("iban", "bias"): -4.0, ("iban", "mod 97"): 5.0,
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
# possessive, and begun at the start of a run: the same matches in time linear in the text
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_NUMBER = re.compile(r"[+(]?[0-9]++(?:[\x20().\-/]{1,2}[0-9]++)*+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}"
                      r"(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63})+")
_SPELLED_HINT = re.compile(r"\(dot\)|\[dot\]|\x20dot\x20")
_CUES = {
    "phone": ("tel", "phone", "call", "mobile", "fax"), "email": ("mail", "contact", "write"),
    "card": ("card", "visa", "payment", "credit"), "iban": ("iban", "account", "bank"), "ip": ("ip", "host", "server"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the patterns' matches that hold, by start, then kind as listed."""
    found = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text)
                  if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _checks(text: str) -> bool:
    """Whether an account number passes its remainder by 97."""
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _pieces(text: str) -> list[tuple[list[tuple[int, int]], str]]:
    """Candidates: lists of neighbouring pieces, and their shape. Segments are runs of pieces."""
    out = []
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            if m.end() - m.start() >= LEAST_RUN:
                cuts = [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[+(]?[0-9]+", m.group())]
                out.append((cuts, "number"))
        out += [([m.span()], "account") for m in _IBAN.finditer(text)]
    if _SPELLED_HINT.search(text):
        out += [([m.span()], "spelled") for m in _SPELLED.finditer(text)]
    if "@" in text:
        out += [([s], "address") for s in emails(text)]
    return out


def _features(text: str, start: int, end: int, shape: str) -> list[str]:
    """What a whole segment looks like."""
    body = text[start:end]
    digits = _digits(body) if end - start <= 64 else "0" * 64
    n = len(digits)
    out = ["bias", f"shape={shape}", f"digits={n if n < 20 else 20}"]
    if shape == "number":
        out += ["luhn"] if 12 <= n <= 19 and luhn(digits) else ["no luhn"]
        out += [f"first={body[0] if body[0] in '+(' else 'digit'}"]
        seps = {c for c in body if not "0" <= c <= "9"}
        out += [f"sep={''.join(sorted(seps)) or 'none'}"]
        if seps == {"."} and body.count(".") == 3:
            out.append("quad in range" if all(int(p[-4:]) <= 255 and len(p) <= 4 for p in body.split(".")) else "quad out of range")
    if shape == "account":
        out.append("mod 97" if _checks(body) else "not mod 97")
    before, after = text[max(0, start - 1):start], text[end:end + 1]
    out.append("joined before" if before.isalnum() or before in {"_", ".", "-", "/"} else "free before")
    out.append("joined after" if after.isalnum() or after in {"_", "/"} else "free after")
    cue = text[max(0, start - 24):start].lower()
    out += [f"cue {kind}" for kind, words in _CUES.items() if any(w in cue for w in words)]
    return out


def _runs(cuts: list[tuple[int, int]], shape: str, walls: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """The pieces of a candidate parted at the walls (disjoint, in order); pieces that a wall touches are left out.
    A run of numbers is a candidate from the length on that a match needs."""
    def walled(start: int, end: int) -> bool:
        at = bisect_right(walls, start, key=lambda w: w[1])
        return at < len(walls) and walls[at][0] < end

    runs: list[list[tuple[int, int]]] = [[]]
    last = cuts[0][0]
    for start, end in cuts:
        if walled(last, end):
            runs.append([])
        if not walled(start, end):
            runs[-1].append((start, end))
        last = end
    for run in runs:
        if run and (shape != "number" or run[-1][1] - run[0][0] >= LEAST_RUN):
            yield run


def _merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Disjoint stretches that the spans cover, in order."""
    out: list[tuple[int, int]] = []
    for a, b, _ in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def best(text: str, weights: dict[tuple[str, str], float], walls: list[tuple[int, int, str]] = ()) -> list[tuple[int, int, str]]:
    """The segments of the highest total score; outside a segment nothing is scored."""
    chosen = []
    merged = _merged(walls)
    for cuts, shape in ((run, shape) for cuts, shape in _pieces(text) for run in _runs(cuts, shape, merged)):
        score, back = [0.0] * (len(cuts) + 1), [None] * (len(cuts) + 1)
        for j in range(1, len(cuts) + 1):
            score[j], back[j] = score[j - 1], None
            for i in range(max(0, j - MOST_PIECES), j):
                start, end = cuts[i][0], cuts[j - 1][1]
                found = _features(text, start, end, shape)
                for kind in SHAPES[shape]:
                    s = score[i] + sum(weights.get((kind, f), 0.0) for f in found)
                    if s > score[j]:
                        score[j], back[j] = s, (i, start, end, kind)
        j, part = len(cuts), []
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                j, *segment = back[j]
                part.append(tuple(segment))
        chosen += part
    return sorted(chosen)


def _lattices(text: str) -> Iterator[tuple[int, list[tuple[int, int, str, list[str]]], list[bool], list[bool]]]:
    """Of each run of pieces: its length, the segments (first piece, end piece, kind, features), which of them the
    patterns leave possible, and which pieces may stay outside segments.

    A base span is taken as it is. Where a check sum or a range fails, a segment is no card or IP address.
    Everything else that no pattern decides is possible either way, so nothing is learned against it.
    """
    base = base_spans(text)
    candidates = _pieces(text)
    reach = {(c[i][0], c[j][1]) for c, _ in candidates for i in range(len(c)) for j in range(i, min(len(c), i + MOST_PIECES))}
    truth: list[tuple[int, int, str]] = []
    for span in base:
        if span[:2] in reach and (not truth or span[0] >= truth[-1][1]):
            truth.append(span)
    walls = _merged([s for s in base if all(s[0] >= b or s[1] <= a for a, b, _ in truth)])
    for cuts, shape in ((run, shape) for cuts, shape in candidates for run in _runs(cuts, shape, walls)):
        mine = [t for t in truth if t[0] < cuts[-1][1] and t[1] > cuts[0][0]]
        segments, possible = [], []
        for j in range(1, len(cuts) + 1):
            for i in range(max(0, j - MOST_PIECES), j):
                start, end = cuts[i][0], cuts[j - 1][1]
                found = _features(text, start, end, shape)
                over = [t for t in mine if t[0] < end and t[1] > start]
                for kind in SHAPES[shape]:
                    segments.append((i, j, kind, found))
                    fails = (kind == "card" and "luhn" not in found) or (kind == "ip" and "quad in range" not in found)
                    possible.append(over == [(start, end, kind)] if over else not fails)
        outside = [all(t[0] >= b or t[1] <= a for t in mine) for a, b in cuts]
        yield len(cuts), segments, possible, outside


def _add(x: float, y: float) -> float:
    """log(exp(x) + exp(y))"""
    low, high = (x, y) if x < y else (y, x)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def _chances(n: int, segments: list, scores: list[float], possible: list[bool], outside: list[bool]) -> tuple[float, list[float]]:
    """Logarithm of the sum over all segmentations, and the probability of each segment: forward and backward sums."""
    forward, backward = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    forward[0] = backward[n] = 0.0
    by_end, by_start = defaultdict(list), defaultdict(list)
    for k, (i, j, _, _) in enumerate(segments):
        if possible[k]:
            by_end[j].append(k)
            by_start[i].append(k)
    for j in range(1, n + 1):
        total = forward[j - 1] if outside[j - 1] else -math.inf
        for k in by_end[j]:
            total = _add(total, forward[segments[k][0]] + scores[k])
        forward[j] = total
    for i in range(n - 1, -1, -1):
        total = backward[i + 1] if outside[i] else -math.inf
        for k in by_start[i]:
            total = _add(total, backward[segments[k][1]] + scores[k])
        backward[i] = total
    whole = forward[n]
    return whole, [math.exp(forward[i] + s + backward[j] - whole) if ok else 0.0
                   for (i, j, _, _), s, ok in zip(segments, scores, possible)]


def learn(texts: list[str], epochs: int = EPOCHS) -> dict[tuple[str, str], float]:
    """Gradient steps on the semi-Markov likelihood of what the patterns decide, drawn to the prior weights."""
    names: dict[tuple[str, str], int] = {k: i for i, k in enumerate(PRIOR)}
    cases = []
    for text in texts:
        for n, segments, possible, outside in _lattices(text):
            if all(possible) and all(outside):
                continue  # nothing is decided
            marks = [[names.setdefault((kind, f), len(names)) for f in found] for _, _, kind, found in segments]
            sizes = [len(m) for m in marks]
            where = np.cumsum([0, *sizes[:-1]])
            cases.append((n, segments, possible, outside, np.concatenate(marks), where, np.array(sizes)))
    prior = np.array([PRIOR.get(k, 0.0) for k in names])
    now = prior.copy()
    for _ in range(epochs):
        for n, segments, possible, outside, marks, where, sizes in cases:
            scores = np.add.reduceat(now[marks], where).tolist()
            _, given = _chances(n, segments, scores, possible, outside)
            _, free = _chances(n, segments, scores, [True] * len(segments), [True] * n)
            up = np.bincount(marks, np.repeat(np.subtract(given, free), sizes), len(now))
            now += STEP * (up - RIDGE * (now - prior))
    return {k: float(now[i]) for k, i in names.items() if now[i]}


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> dict:
    """Weights from a bounded sample; only the surroundings of candidates come to the driver."""
    sample = (keyed_text(docs, id_col, text_col).where(F.col("text").rlike("[0-9@]"))
              .orderBy(F.xxhash64("doc_id"), F.col("doc_id")).limit(train_docs))

    def around(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for text in batch.column("text").to_pylist():
            for cuts, _ in _pieces(text):
                out.append(text[max(0, cuts[0][0] - TRAIN_REACH):cuts[0][0] + 2 * TRAIN_REACH])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["window"])

    return learn(sorted({r.window for r in map_batches(sample, around, "window string").collect()}))


def find(docs: DataFrame, weights: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans``: kind, start, end (code points, end exclusive) and whether a base pattern found it."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for text in batch.column("text"):
            text = text.as_py()
            base = base_spans(text)
            more = best(text, weights, base) if weights else []
            rows = [(*s, True) for s in base] + [(*s, False) for s in more]
            rows.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
            out.append([{"kind": k, "start": a, "end": b, "base": is_base} for a, b, k, is_base in rows])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    rows = keyed_text(docs, id_col, text_col)
    kept = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, run, f"doc_id {kept}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
