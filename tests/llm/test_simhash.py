import random

import numpy as np
import pytest
import xxhash

from findara.llm.simhash import Plan, components, drop_near_duplicates, fingerprint, near_duplicates, shingles

NEAR = Plan(words=5, distance=39, segments=4, lanes=3)


def brute(rows, plan):
    fps = np.array([fingerprint(r["text"], plan) for r in rows], np.uint64)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if np.bitwise_count(fps[i] ^ fps[j]).sum() <= plan.distance:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return sorted(((r["doc_id"], f"{int(fps[i][0]):016x}", least.get(find(i))) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("table,tile", [("awkward", 8192), ("prose", 8192), ("prose", 3), ("empty", 8192)])
def test_components(request, table, tile):
    df = request.getfixturevalue(table)
    got = near_duplicates(df, Plan(), tile=tile).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == brute(df.collect(), Plan())


def test_every_link_within_the_distance_is_found(spark):
    """Fingerprints up to five bits apart, directly as nodes."""
    from findara.llm.simhash import links

    rng, values = random.Random(5), []
    for _ in range(60):
        f = rng.getrandbits(64)
        values += [f, f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7)))]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    for plan in (Plan(), Plan(distance=2, segments=2), Plan(distance=7, segments=4)):
        assert plan.complete
        found = links(spark.createDataFrame([(v,) for v in signed], "_fp0 long"), plan).collect()
        got = {frozenset((r["_a"], r["_b"])) for r in found}
        want = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= plan.distance}
        assert got == want
    assert not NEAR.complete


def test_fingerprint_by_hand():
    assert fingerprint(None, Plan()) == [0] == fingerprint(" \t", Plan())
    assert fingerprint("Ab cD", Plan()) == [xxhash.xxh64_intdigest("ab cd", 42)]
    two = [xxhash.xxh64_intdigest(s, 42) for s in ("a b c d", "b c d e")]
    assert fingerprint("a b c d e", Plan()) == [two[0] & two[1]]


def test_chunks_do_not_show(monkeypatch):
    text = " ".join(f"w{k}" for k in range(500)) + "  \n tail"
    whole, sets = fingerprint(text, NEAR), shingles(text, 5)
    monkeypatch.setattr("findara.llm.simhash.CHUNK", 37)
    assert fingerprint(text, NEAR) == whole and (shingles(text, 5) == sets).all() and len(sets) == 497


def test_components_of_a_path(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (105, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "_a long, _b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 105: 100}


def jaccard(a, b):
    def sets(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y) if x | y else 0


def test_near_copies_go_and_others_stay(prose):
    rows = {r["doc_id"]: r["text"] for r in prose.collect()}
    kept = {r["doc_id"] for r in drop_near_duplicates(prose, NEAR).collect()}
    for i, t in rows.items():
        like = [j for j, u in rows.items() if j < i and jaccard(t, u) >= 0.8]
        if i in kept:
            assert not any(jaccard(t, rows[j]) >= 0.9 for j in like)
        else:
            assert like


def test_awkward_rows(awkward, empty):
    got = sorted(str(r["doc_id"]) for r in drop_near_duplicates(awkward, NEAR).collect())
    assert got == ["1", "3", "4", "5", "6", "8", "None"]  # texts without words all stay
    named = awkward.withColumnsRenamed({"lang": "_id", "source": "_h", "rank": "_text"})
    assert drop_near_duplicates(named, NEAR).columns == named.columns and drop_near_duplicates(named, NEAR).count() == 7
    assert drop_near_duplicates(empty, NEAR).count() == 0


def similar_pairs_meet(rows, kept):
    """Whether every group of pairs at 0.8 or more has one kept row, and others all theirs."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i], rows[j]) >= 0.8:
                root[find(i)] = find(j)
    return kept == {min(j for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))}


@pytest.mark.parametrize("tile", [8192, 20])
def test_near_copies_within_a_template_group_go(spark, tile):
    """Pages of one template, each unlike the others, and each with a copy that differs in a word."""
    rng = random.Random(11)
    template, rows = [f"t{k}" for k in range(300)], []
    for page in range(60):
        own = [f"p{page}x{k}" for k in range(50)]
        rows += [" ".join(template + own), " ".join(template + own[:-1] + [f"c{page}"])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r["doc_id"] for r in drop_near_duplicates(docs, NEAR, tile=tile).collect()}
    assert len(kept) == 60 and similar_pairs_meet(rows, kept)


def test_texts_of_one_fingerprint_that_differ_stay(spark):
    """A line that outweighs all else gives different texts the same fingerprint."""
    line = "home about contact terms privacy help login share follow subscribe copyright"
    rows = [" ".join([line] * 100 + [f"p{page}x{k}" for k in range(80)]) for page in range(3)]
    assert len({tuple(fingerprint(t, NEAR)) for t in rows}) == 1 and jaccard(*rows[:2]) < 0.15
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert drop_near_duplicates(docs, NEAR).count() == 3


def test_near_copies_with_a_repeated_line_go(spark):
    line = "home about contact terms privacy help login share follow subscribe copyright"
    text = " ".join(f"w{k}" for k in range(200))
    rows = [text, " ".join([text] + [line] * 100)]
    assert jaccard(*rows) >= 0.9
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert [r["doc_id"] for r in drop_near_duplicates(docs, NEAR).collect()] == [0]


def test_recall_and_precision_at_the_threshold(spark):
    """120 pairs of similarity 0.8 to 0.97, and as many of 0.5 to 0.75, each against its true Jaccard similarity."""
    rng = random.Random(17)
    rows, near, far = [], [], []
    while len(near) < 120 or len(far) < 120:
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(80, 500))]
        changed = list(words)
        for at in rng.sample(range(len(words)), max(1, int(len(words) * rng.uniform(0.002, 0.08)))):
            changed[at] = f"c{rng.randrange(5000)}"
        a, b = " ".join(words), " ".join(changed)
        j = jaccard(a, b)
        into = near if 0.8 <= j < 0.97 else far if 0.5 <= j < 0.75 else None
        if into is not None and len(into) < 120:
            into.append(len(rows) + 1)
            rows += [a, b]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    gone = {r["doc_id"] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in drop_near_duplicates(docs, NEAR).collect()}
    assert gone <= set(near) and len(gone) >= 0.9 * len(near)
