"""Plain Python versions of the training-data operators, and awkward documents to run them on."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}
EXTRA = ("_text", "_id", "_row", "key", "n", "node", "_salt", "_range", "_order", "_copy")


def awkward_texts() -> list:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = say(220), say(80)
    near = base.split()
    near[100] = "changed"
    return [
        None, "", " ", "\n\t ", "one", "one two three", "One two THREE", "a b c d", "a b c d e",
        base, base, "  " + base.replace(" ", "  "), " ".join(near), base + " tail words here now again",
        say(30) + " " + passage + " " + say(30), passage + " " + say(20), say(25) + "\n" + passage,
        "x" * 500, "x" * 700, "ab" * 300, say(3000), ("line of text that repeats\n" * 60), "é" * 250 + "ü 🙂 " + "中文" * 120,
        "it's we'll  don't 'tis !'s 123½   x\r\n\r\n  end  ", "nul\x00byte \x1c\x85 sep", say(49), say(50), say(51), say(50), "Ünïcödé " * 40,
    ]


def rows(texts: list) -> list[tuple]:
    return [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]


def frame(spark, data: list[tuple], extra: bool = True):
    """documents of rows, with further columns whose names clash with those that operators may use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for k, name in enumerate(EXTRA if extra else ()):
        df = df.withColumn(name, F.lit(f"extra {k}") if k % 2 else F.lit(k))
    return df


def exact_groups(data):
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(WORD_SPACE.sub("", t or ""), []).append((-len(t or ""), i))
    out = {}
    for i, t, *_ in data:
        norm = WORD_SPACE.sub("", t or "")
        keep = min(groups[norm])[1]
        out[i] = (keep, len(groups[norm]), keep == i, hashlib.sha256(norm.encode()).hexdigest())
    return out


WORD_SPACE = re.compile("[\x20\x09-\x0d]")


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def near_components(data):
    sets = {i: shingles(t) for i, t, *_ in data}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    up[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def removed_words(data, size=50):
    seen, out = {}, {}
    for i, t, *_ in sorted(data):
        w = WORD.findall(t or "")
        gone, own = [False] * len(w), []
        for s in range(len(w) - size + 1):
            window = tuple(w[s : s + size])
            if window in seen:
                gone[s : s + size] = [True] * size
            own.append(window)
        for window in own:
            seen.setdefault(window, i)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def removed_bytes(data, size=200):
    texts = [(i, (t or "").encode()) for i, t, *_ in data]
    count = Counter(t[s : s + size] for _, t in texts for s in range(len(t) - size + 1))
    out = {}
    for i, t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - size + 1):
            if count[t[s : s + size]] > 1:
                gone[s : s + size] = b"\1" * size
        spans = sum(1 for k in range(len(t)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


def token_starts(data, encode, end_id=2):
    out, start = {}, 0
    for i, t, *_ in sorted(data, key=lambda r: r[0]):
        ids = [*encode(t or ""), end_id]
        out[i] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    return out


def captures(pages, least=0):
    payload = {i: (h or "").encode() for i, _, h in pages}
    best = {}
    for i, p in payload.items():
        if len(p) >= least:
            best[p] = max(best.get(p, i), i)
    name = lambda p: base64.b32encode(hashlib.sha1(p).digest()).decode()
    return {i: (len(p), name(p), "response" if best.get(p, i) == i else "revisit", None if best.get(p, i) == i else best[p]) for i, p in payload.items()}
