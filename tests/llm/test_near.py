"""The join, paragraph deduplication and fingerprints against brute force."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from quirework.llm import blocks, ngram_join, paragraphs, simhash
from quirework.llm.shingles import mix, shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else [])


def brute(docs, percent=85):
    """docs: list of (id, text): size, component, links of each place."""
    sets, parent = [shingles(t) for _, t in docs], list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(docs)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(root(i), []).append(d)
    least = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return sorted(((d, len(s), least[root(i)], links[i]) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in df.collect()), key=str)


def family(rng, n, words=120, edits=9):
    base = [f"v{rng.randint(0, 5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_shingles_are_those_of_words():
    texts = [" A b\tc\nd E ", "a B c", "", None, "É é\x1cx  y \xa0z q", "a b c d a b c d a b c d"]
    sizes = [len(s) for s in shingle_sets([t.encode() if t is not None else None for t in texts], 4)]
    assert sizes == [len(shingles(t)) for t in texts]
    one, two = shingle_sets([b"A b C d e", b"x a\nB c D E"], 4)
    assert len(set(one.tolist()) & set(two.tolist())) == 2


def test_join_against_brute_force(spark, odd, clashing, nothing):
    rng = random.Random(11)
    common = " ".join(f"lic{i}" for i in range(40))
    docs = [t for _ in range(6) for t in family(rng, 12)] + family(rng, 60, edits=20)
    docs += [f"{t} {common}" for t in (" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(3, 60))) for _ in range(60))]
    docs += [docs[0]] * 30 + ["x y", "x  Y", "p q r", ""]
    numbered = list(enumerate(docs, 1000))
    rng.shuffle(numbered)
    df = spark.createDataFrame(numbered, "doc_id long, text string").repartition(5)
    assert rows_of(ngram_join.join_documents(df)) == brute(numbered)
    assert rows_of(ngram_join.join_documents(clashing)) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert ngram_join.join_documents(nothing).count() == 0


def test_blocks_of_near_copies_give_few_edges():
    """Pairs of blocks connect what links connect, with no more edges between two blocks than they need."""
    rng = np.random.default_rng(4)

    def component(edges, ids):
        label = {i: i for i in ids}
        for _ in ids:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    base = [rng.integers(0, 1 << 62, 100, dtype=np.uint64) for _ in range(7)]
    for kinds, own in ((1, 1), (3, 6), (7, 40)):
        sets = [np.unique(np.concatenate([base[rng.integers(kinds)][rng.permutation(100) < 100 - rng.integers(own)], rng.integers(0, 1 << 62, rng.integers(own), dtype=np.uint64)])) for _ in range(90)]
        parts = [(np.arange(k, k + 30), np.ones(30, np.int64), sets[k : k + 30]) for k in (0, 30, 60)]
        near = [(i, j) for i in range(90) for j in range(i) if 180 * len(np.intersect1d(sets[i], sets[j])) >= 80 * (len(sets[i]) + len(sets[j]))]
        edges, links = [], np.zeros(90, int)
        for x in range(3):
            alone = [e for kind, *e in zip(*blocks.linked_in(parts[x], None, 80)) if kind == 0]
            edges += alone
            for y in range(x):
                found = list(zip(*blocks.linked_in(parts[y], parts[x], 80)))
                across = [(a, b) for kind, a, b in found if kind == 0]
                assert all((a // 30, b // 30) in ((x, y), (y, x)) for a, b in across)
                assert own > 1 or len(across) == 1
                edges += across
                for kind, a, b in found:
                    links[a] += b * (kind == 1)
            for kind, a, b in zip(*blocks.linked_in(parts[x], None, 80)):
                links[a] += b * (kind == 1)
        assert component(edges, range(90)) == component(near, range(90))
        assert links.tolist() == np.bincount(np.array(near).ravel(), minlength=90).tolist()


def test_join_is_the_same_with_other_orders(spark, monkeypatch):
    """The list of frequent tokens and the block size may change the work, not the result."""
    rng = random.Random(12)
    docs = list(enumerate([t for _ in range(3) for t in family(rng, 40, edits=14)]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 2)
    monkeypatch.setattr(blocks, "BLOCK_SETS", 7)
    assert rows_of(ngram_join.join_documents(df)) == want
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 10**9)
    assert rows_of(ngram_join.join_documents(df)) == want


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.choice(2000, rng.integers(1, 900), replace=False).astype(np.uint64) * np.uint64(7919) for _ in range(2))
        assert ngram_join.most_shared(ngram_join.bitmap(a), ngram_join.bitmap(b), len(a) + len(b)) >= len(np.intersect1d(a, b))


def test_paragraphs(spark, odd, clashing, nothing):
    rng = random.Random(13)
    line = lambda n, tag: " ".join(f"{tag}{rng.randint(0, 10**6)}" for _ in range(n))
    shared, passage = line(55, "s"), ". ".join(line(12, "P") for _ in range(5)) + "."
    near = shared.split()
    near[30] = "edited"
    docs = [(i, f"{line(20, 'a')}\n{line(30, 'b')}") for i in range(1, 40)]
    docs += [(50, f"{line(20, 'c')}\n{shared}"), (51, f"{shared.upper()}\n{line(15, 'd')}"), (52, " ".join(near)), (60, f"{line(10, 'E')}. {passage} {line(9, 'F')}."), (61, f"{line(14, 'G')}. {passage} {line(11, 'H')}."), (70, "short one\nshort one\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = paragraphs.duplicate_units(df).collect()
    assert {(r.doc_id, r.level) for r in got} == {(50, "paragraph"), (51, "paragraph"), (52, "paragraph"), (60, "sentence"), (61, "sentence")}
    assert {(r.doc_id, r.cluster_doc_id, r.cluster_size, r.removed) for r in got if r.level == "paragraph"} == {(50, 50, 3, False), (51, 50, 3, True), (52, 50, 3, True)}
    assert sum(r.n_words for r in got if r.doc_id == 61 and r.removed) >= 48
    left = {r.doc_id: r.text for r in paragraphs.deduplicated(df).collect()}
    assert len(left) == len(docs) and left[52] == "" and left[51] == dict(docs)[51].split("\n")[1] and left[50] == dict(docs)[50] and left[70] == "short one\nshort one\n"
    assert passage.split(". ")[2] not in left[61] and passage in left[60]
    rows = paragraphs.duplicate_units(clashing).collect()
    assert {r.doc_id for r in rows} == {2, 4, 6, 100} and sum(not r.removed for r in rows) == 1
    assert paragraphs.duplicate_units(nothing).count() == 0
    kept = paragraphs.deduplicated(clashing)
    assert kept.columns == clashing.columns and kept.count() == 14


def test_of_equal_rows_one_keeps_its_text(spark):
    """Rows that share doc_id and text, and rows without doc_id."""
    rng = random.Random(14)
    a, b = (" ".join(f"r{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(2))
    df = spark.createDataFrame([(9, a), (9, a), (9, b), (None, b), (None, b), (4, "few words")], "doc_id long, text string").repartition(3)
    left = sorted(((r.doc_id or 0, r.text) for r in paragraphs.deduplicated(df).collect()))
    assert left == sorted([(9, a), (9, ""), (9, ""), (0, b), (0, ""), (4, "few words")])
    got = sorted((r.doc_id or 0, r.n_words, r.cluster_size, r.removed) for r in paragraphs.duplicate_units(df).collect())
    assert got == sorted([(9, 40, 2, False), (9, 40, 2, True), (0, 40, 3, False), (0, 40, 3, True), (9, 40, 3, True)])


def plain_paragraphs(docs):
    """doc_id, first word and removed of the paragraphs that are in clusters, where every repeated line has 20 words or more: all pairs compared."""
    lines, out = [], []
    for d, t in docs:
        at = 0
        for line in (t or "").split("\n"):
            w = line.translate(LOWER).split()
            if w:
                lines.append((d, at, tuple(w), shingles(line, 5) if len(w) >= 12 else frozenset()))
            at += len(w)
    parent = list(range(len(lines)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(lines):
        for j in range(i):
            y = lines[j]
            if x[2] == y[2] or x[3] and y[3] and 100 * len(x[3] & y[3]) >= 80 * len(x[3] | y[3]):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(lines)):
        groups.setdefault(root(i), []).append(lines[i][:2])
    for g in groups.values():
        if len(g) > 1:
            out += [(d, at, (d, at) != min(g)) for d, at in g]
    return sorted(out)


def test_paragraph_clusters_against_all_pairs(spark):
    rng = random.Random(15)
    pool = [t for _ in range(8) for t in family(rng, 6, words=rng.randint(25, 60), edits=3)]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.unit, r.removed) for r in paragraphs.duplicate_units(df).collect() if r.level == "paragraph")
    assert got == plain_paragraphs(docs) and len(got) > 50


def test_banding_finds_what_it_should():
    rng = np.random.default_rng(5)
    bands, found = paragraphs.tuned(), 0
    for _ in range(400):
        a = rng.integers(1, 1 << 62, 90, dtype=np.uint64)
        b = np.concatenate([a[:80], rng.integers(1, 1 << 62, 10, dtype=np.uint64)])  # a Jaccard index of 0.8
        x, y = paragraphs.signatures(mix(np.concatenate([a, b])), np.array([0, len(a)]), bands)
        found += bool((x == y).any())
    assert found >= 390


def fingerprint(text):
    from xxhash import xxh64_intdigest

    total, weight = [0] * 64, 0
    for term in re.split(simhash.SPACES.replace(r"\x{85}\x{A0}\x{3000}", "\x85\xa0　").replace(r"\s", " \t\n\x0b\f\r"), text.lower()):
        h, w = xxh64_intdigest(term.encode(), 42), min(len(term), simhash.MAX_LENGTH) ** 2
        weight += w
        for i in range(64):
            total[i] += w * (h >> i & 1)
    return sum(1 << i for i in range(64) if total[i] > weight // 2)


def test_fingerprints(spark, odd, clashing, nothing):
    rng = random.Random(3)
    docs = [(i, f"{' '.join(rng.choice(['alpha', 'Beta', 'é', 'gamma\n', '漢字', 'x']) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 30)))}") for i in rng.sample(range(5000), 1200)]
    got = {r.doc_id: r for r in simhash.fingerprint_table(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(got) == 1200
    order = sorted(docs, reverse=True)
    prints = {t: fingerprint(t) for _, t in docs}
    like = lambda a, b: 1 - (a ^ b).bit_count() / 64
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        edited, r = t[: len(t) - len(t) // 2] + n[: len(t) // 2], got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert int(r.fingerprint, 16) == prints[t] and int(r.edited_fingerprint, 16) == fingerprint(edited)
        assert r.near_next == like(prints[t], prints[n]) and r.near_edited == like(prints[t], fingerprint(edited))
        want = sum((prints[t] ^ prints[x]).bit_count() <= simhash.RADIUS for _, x in docs) if d % 100 == 0 else None
        assert r.near_docs == want
    rows = simhash.fingerprint_table(clashing).collect()
    assert len(rows) == 14 and {r.fingerprint for r in rows if r.doc_id in (3, 5)} == {"0" * 16}
    assert simhash.fingerprint_table(nothing).count() == 0
    assert simhash.fingerprint_table(odd.where("doc_id = 2")).first().near_next == 1.0


def test_search_misses_nothing(spark):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for x in list(fps[:100]):
        y = x
        for _ in range(rng.randint(0, 5)):
            y ^= 1 << rng.randrange(64)
        fps.append(y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(x),) for x in fps + fps[:50]], "fp long")
    q = rows.limit(450).where(F.col("fp") % 3 == 0)
    for radius, n in ((3, 6), (2, 4), (0, 2)):
        asked = {r.fp & (1 << 64) - 1 for r in q.collect()}
        got = {(r.query_fp & (1 << 64) - 1, r.fp & (1 << 64) - 1, r.distance) for r in simhash.within_radius(q, rows, radius, n).collect()}
        assert got == {(a, b, (a ^ b).bit_count()) for a in asked for b in set(fps) if (a ^ b).bit_count() <= radius}


def test_frequent_tokens_are_counted_in_little_memory():
    rng = np.random.default_rng(3)
    for parts in ([rng.integers(0, 40, 90).astype(np.uint64), np.array([2**64 - 1] * 2, np.uint64)], [np.array([5], np.uint64)], [rng.integers(0, 2**63, 3_000_000).astype(np.uint64), np.full(1000, 9, np.uint64)]):
        tokens, n = np.unique(np.concatenate(parts), return_counts=True)
        size = sum(p.nbytes for p in parts)
        held = list(parts)
        tracemalloc.start()
        found, counts = ngram_join.frequent_in(held)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert not held and np.array_equal(found, tokens[n >= 2]) and np.array_equal(counts, n[n >= 2])
        assert most < 1.6 * size + 100_000  # beside the arrays themselves; np.unique takes 3 to 5 times their size
