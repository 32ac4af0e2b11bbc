"""Plain versions of the corpus operators, and a table of awkward rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"w{i}" for i in range(70))
COPY = "one two three four five six seven"
#: doc_id, text, source: nulls in any column, empty and long texts, ties, repeated rows.
AWKWARD = [
    (1, None, "a"), (2, "", "b"), (3, " \t\n", None), (4, COPY, "a"), (5, COPY, "a"), (5, COPY, "a"), (6, COPY.upper(), "b"),
    (7, PASSAGE, "a"), (8, "x y z " + PASSAGE + " tail", "b"), (9, PASSAGE + " " + PASSAGE, None), (None, PASSAGE + " end", "c"),
    (10, "é ñ 漢字 İ \x1c\x85 😀 password: \"abcdefgh12\" mail a.b@c.example.org +1 (274) 555-9629", "c"),
    (11, "word " * 30000, "a"), (12, "a" * 40000 + " " * 9000 + "b", "b"), (None, None, None), (13, PASSAGE.replace("w3 ", "v3 "), "a"),
]


def awkward(spark, rows=AWKWARD):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame(
        [(*r, "en", 1, "x", 0.5, 7) for r in rows],
        "doc_id long, text string, source string, lang string, n long, kind string, h double, mark int")


def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}


def rank_ids(texts):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    return [enc.encode_ordinary(t or "") for t in texts]


def word_ids(texts):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def passages(rows, words=50):
    """doc_id, n_words, n_removed, kept_sha256 of rows (doc_id, text)."""
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, ws in split:
        for i in range(len(ws) - words + 1):
            key = tuple(ws[i:i + words])
            first[key] = min(first.get(key, float("inf")), float("inf") if d is None else d)
    out = []
    for d, ws in split:
        gone = set()
        for i in range(len(ws) - words + 1):
            if first[tuple(ws[i:i + words])] < (float("inf") if d is None else d):
                gone.update(range(i, i + words))
        out.append((d, len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone))))
    return out


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    ws = WORD.findall(low)
    if not ws:
        return 0
    shingles = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, links):
    """Root of each of ``n`` items under links (i, j)."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in links:
        root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def smallest(ids, roots):
    least = defaultdict(lambda: None)
    for d, r in zip(ids, roots):
        if d is not None:
            least[r] = d if least[r] is None else min(least[r], d)
    return [least[r] for r in roots]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Source -> target, by handing the excess on until none is left."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, budget, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = budget / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            budget -= out[s]
        free -= over
    return out


def counted(rows):
    return Counter(map(tuple, rows))
