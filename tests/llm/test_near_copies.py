"""Near copies against brute-force Jaccard similarity of whole shingle sets."""

import random

from folioquery.llm import jaccard
from folioquery.llm.simhash import drop_near_duplicates


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def survivors(rows):
    """Smallest ids of the components of pairs at Jaccard 0.8 or more."""
    sets = [(i, shingles(t)) for i, t in sorted(rows)]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted(i for i in up if up[i] == i)


def left(spark, rows):
    return sorted(r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def corpus(seed, edit):
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 500))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(3):
            rows.append((len(rows), " ".join(edit(rng, base))))
    return rows


def test_appended_and_truncated_copies_are_all_found(spark):
    def edit(rng, base):
        if rng.random() < 0.5:
            return base + [f"x{rng.randrange(3000)}" for _ in range(int(len(base) * rng.choice([0.1, 0.15, 0.2, 0.24])))]
        return base[: int(len(base) * rng.choice([0.82, 0.85, 0.9]))]

    rows = corpus(3, edit)
    assert left(spark, rows) == survivors(rows)


def test_dense_buckets_lose_no_pair(spark, monkeypatch):
    # One text in many versions and one passage in unlike texts, with small steps, so that every way is taken.
    monkeypatch.setattr(jaccard, "REPS", 1)
    monkeypatch.setattr(jaccard, "COMMON_KEPT", 5)
    rng = random.Random(4)
    base = [f"w{rng.randrange(3000)}" for _ in range(100)]
    rows = []
    for k in range(250):
        text = list(base)
        for _ in range(1 + k % 4):
            text[rng.randrange(100)] = f"y{rng.randrange(10**6)}"
        rows.append((k, " ".join(text if k % 5 else base[:40] + text[40:70] + [f"z{rng.randrange(10**6)}" for _ in range(12)])))
    assert left(spark, rows) == survivors(rows)


def test_texts_below_the_similarity_stay(spark):
    # Rows of a base of 200 words and the same with the last eighth to sixth replaced: Jaccard 0.71 to 0.78.
    rng = random.Random(6)
    rows = []
    for k in range(40):
        base = [f"u{rng.randrange(10**6)}" for _ in range(200)]
        cut = 24 + k % 10
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: 200 - cut] + [f"t{rng.randrange(10**6)}" for _ in range(cut)]))]
    assert survivors(rows) == list(range(80))
    assert left(spark, rows) == list(range(80))


def test_copies_in_one_fingerprint_are_verified(spark, monkeypatch):
    # With a limit of 64 bits the index links everything; only what has the similarity may stay linked.
    monkeypatch.setattr(jaccard, "BITS", 64)
    rng = random.Random(12)
    rows = corpus(12, lambda rng, base: [w if rng.random() > 0.01 else f"x{rng.randrange(3000)}" for w in base])[:120]
    rows += [(1000 + k, rows[k][1].upper()) for k in range(0, 120, 7)] + [(2000 + k, "one text of many copies in a row") for k in range(200)]
    assert left(spark, rows) == survivors(rows)
