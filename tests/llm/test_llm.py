import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftspark.llm import graph, itq, linedups, minhash, mixing, packing, passages, secrets, sharding, sketch, suffixes, toxicity
from siftspark.llm import vectext as V

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ["id", "key", "h", "x", "node", "root", "a", "b", "value", "tokens", "label", "rep", "_gone", "_key", "_drop", "_n", "_source", "words", "keys", "group", "wanted"]


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def frame(spark, texts, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s" if sources is None else sources[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, clashing columns."""
    rng = random.Random(8)
    long = sentence(rng, 60_000)
    shared = sentence(rng, 80)
    rows = [
        (None, None, None, None, None), (None, shared, "en", "s", 5), (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, " \n\t\n ", None, "s", 5), (4, "word", "en", None, 4), (5, long, "en", "s", len(long)),
        (5, long, "en", "s", len(long)), (6, shared, "de", "t", 3), (6, shared, "de", "t", 3), (7, shared, "en", "s", 1), (8, "!!! ... ???", "en", "s", 11), (9, f"{shared}\n{shared}", "en", "s", 9), (10, "é" * 5000, "en", "u", 5000),
        (5, "another text of the same id", "en", "s", 3), (11, long + " x", "en", "s", None), (12, "\x00 odd \x00\n\n", "en", "s", 8),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for i, c in enumerate(CLASHING):
        df = df.withColumn(c, F.lit(i))
    return df


def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (4, 1, 0), (5, 1, 0), (6, None, 0), (7, 0, None), (None, 1, 1), (8, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "minhash": lambda s, d: minhash.near_duplicates(d), "keep_one": lambda s, d: minhash.keep_one(d), "lines": lambda s, d: linedups.repeated_lines(d), "without_repeats": lambda s, d: linedups.without_repeats(d),
    "mix": lambda s, d: mixing.mix(d), "mixed": lambda s, d: mixing.mixed_documents(d), "toxic": lambda s, d: toxicity.toxic_documents(d, labels(s)), "clean": lambda s, d: toxicity.clean_documents(d, labels(s)),
    "passages": lambda s, d: passages.repeated_passages(d), "secrets": lambda s, d: secrets.scan_secrets(d), "shard": lambda s, d: sharding.shard(d, shards=3), "sketch": lambda s, d: sketch.fingerprints(d), "pack": lambda s, d: packing.pack(d),
}


@pytest.fixture(scope="module")
def odd(spark):
    return {name: op(spark, awkward(spark)).collect() for name, op in OPERATORS.items()}


def test_awkward_rows(odd, spark):
    columns = awkward(spark).columns
    assert {(r["doc_id"], r["duplicate_of"], r["group_size"]) for r in odd["minhash"]} == {(7, 6, 3), (9, 6, 3), (11, 5, 2)}
    assert sorted((r["doc_id"] for r in odd["keep_one"]), key=lambda x: (x is not None, x)) == [None, None, 1, 2, 3, 4, 5, 5, 5, 6, 6, 8, 10, 12]
    gone = {(r["doc_id"], r["line"]): (r["kept_doc_id"], r["kept_line"]) for r in odd["lines"]}
    assert gone == {(7, 0): (6, 0), (9, 0): (6, 0), (9, 1): (6, 0), (11, 0): (5, 0)}
    left = {r["doc_id"] for r in odd["without_repeats"]}
    assert left == {None, 1, 2, 3, 4, 5, 6, 8, 10, 12}
    for name in ("keep_one", "without_repeats", "mixed", "clean"):
        assert list(odd[name][0].asDict()) == columns and odd[name][0][CLASHING[-1]] == len(CLASHING) - 1, name
    assert len(odd["clean"]) == 17 and odd["toxic"] == []
    spans = {(r["doc_id"], r["kept"]) for r in odd["passages"]}
    assert spans == {(5, True), (11, False), (6, True), (7, False), (9, False)}
    assert sum(r["shingles"] > 0 for r in odd["sketch"]) == 12 and len(odd["sketch"]) == 17
    assert {(r["group_key"], r["size"]) for r in odd["shard"]} >= {(None, 0 + len(sentence(random.Random(0), 0)) + next(r["size"] for r in odd["shard"] if r["group_key"] is None)), (1, 0), (2, 0)}
    assert len(odd["shard"]) == 13 and odd["secrets"] == []
    packed = [p for r in odd["pack"] for p in zip(r["doc_ids"], r["begins"], r["lengths"], strict=True)]
    assert sum(n for _, _, n in packed) == sum(len(re.findall(r"[^ \t\n\r]+", t or "")) for t in (r["text"] for r in awkward(spark).select("text").collect()))
    assert all(r["tokens"] <= packing.CAPACITY for r in odd["pack"])
    assert any(r["doc_id"] is None for r in odd["mix"])


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], DOCS)).count() == 0


def test_vectors_awkward(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.01]), (2, [2.0, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]), (None, [1.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0, 0.0, 0.0]), (9, [0.0, -3.0]), (10, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(0)).withColumn("v", F.lit(0)).withColumn("root", F.lit(0))
    assert [tuple(r) for r in itq.near_vectors(df).collect()] == [(2, 1, 2)]
    assert itq.near_vectors(df.where("vec_id > 99")).count() == 0
    assert itq.near_vectors(df.where("vec_id = 9")).count() == 0


def test_words():
    rng = random.Random(1)
    characters = list("ab1 .é°ªß“…—　、中国語ひらがなカタไทย한국русский😀→«»\n")
    texts = ["".join(rng.choice(characters) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    column = V.strings(pa.array(texts))
    for low, raw, offsets in V.slices(column):
        found = V.words(raw, offsets)
        for r in range(found.rows):
            got = [bytes(raw[found.starts[i] : found.ends[i]]).decode() for i in range(found.first[r], found.first[r + 1])]
            assert got == WORD.findall(column[low + r].as_py())


# 1 and the graph

def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    root = {n: n for p in pairs for n in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    want = {n: r for n, r in root.items() if any(n in p and p[0] != p[1] for p in pairs)}
    edges = spark.createDataFrame(pairs, "a long, b long")
    for most in (10**6, 0):
        assert {r["node"]: r["root"] for r in graph.components(edges, most).collect()} == want


def _shingles(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}


def test_minhash_against_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        base = sentence(rng, 120).split()
        texts.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            for _ in range(rng.choice([1, 2, 4])):
                other[rng.randrange(len(other))] = "edited"
            texts.append(" ".join(other))
    texts += [sentence(rng, 120) for _ in range(60)]
    got = {r["doc_id"]: r["duplicate_of"] for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    sets = [_shingles(t) for t in texts]
    near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6]
    found = sum(got.get(i, i) == got.get(j, j) for i, j in near)
    assert len(near) > 200 and found >= 0.98 * len(near)
    assert all(i < 160 and got[i] // 4 == i // 4 for i in got)


def test_packed_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 32, (200, minhash.K), dtype=np.uint32)
    y = rng.integers(0, 1 << 32, (200, minhash.K), dtype=np.uint32)
    same = rng.random((200, minhash.K)) < 0.7
    y[same] = x[same]
    assert abs(minhash.similarity(minhash.pack(x), minhash.pack(y)).mean() - 0.7) < 0.03
    assert (minhash.similarity(minhash.pack(x), minhash.pack(x)) == 1).all()


# 2

WORD = re.compile(V.word_pattern("\\U{:08x}"))


def _myers(a, b):
    """Levenshtein distance, a column of the textbook's table at a time in the bits of an integer."""
    places = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    if not a:
        return len(b)
    mask, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = mask, 0, len(a)
    for c in b:
        eq = places.get(c, 0)
        vertical, horizontal = eq | minus, (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (~(horizontal | plus) & mask), plus & horizontal
        score += bool(up & last) - bool(down & last)
        up = ((up << 1) | 1) & mask
        plus, minus = ((down << 1) & mask) | (~(vertical | up) & mask), up & vertical
    return score


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(2)
    pairs = []
    for _ in range(3000):
        a = "".join(rng.choice("ab cé中") for _ in range(rng.choice([0, 3, 14, 40, 120])))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = [rng.choice("ab cé中")] * rng.randint(0, 2)
        pairs.append((a, "".join(b)))
    distances = [_levenshtein(a, b) for a, b in pairs]
    assert distances == [_myers(a, b) for a, b in pairs]
    texts, n = linedups.Texts(pa.array([a for a, _ in pairs] + [b for _, b in pairs])), len(pairs)
    for similarity in (0.5, 0.7, 0.9, 0.95, 1.0):
        want = [d <= linedups.most_edits(max(len(a), len(b)), similarity) for d, (a, b) in zip(distances, pairs, strict=True)]
        assert texts.alike(np.arange(n), np.arange(n, 2 * n), similarity).tolist() == want


def test_unlike_pairs_are_told_by_their_runs(monkeypatch):
    # Variants of one line, each within the similarity of the line but not of each other, are told apart without the diagonals.
    rng = random.Random(4)
    base = sentence(rng, 60)
    variants = ["".join(rng.choice("qrstuv") if i in at else c for i, c in enumerate(base)) for _ in range(60) for at in [set(rng.sample(range(len(base)), int(len(base) * 0.048)))]]
    i, j = np.array(list(itertools.combinations(range(len(variants)), 2))).T
    want = [_myers(variants[x], variants[y]) <= linedups.most_edits(max(len(variants[x]), len(variants[y])), linedups.SIMILARITY) for x, y in zip(i, j, strict=True)]
    decided = []
    reached = linedups.Texts._reached
    monkeypatch.setattr(linedups.Texts, "_reached", lambda self, a, b, most: decided.append(len(a)) or reached(self, a, b, most))
    assert linedups.Texts(pa.array(variants)).alike(i, j, linedups.SIMILARITY).tolist() == want
    assert sum(decided) < 0.2 * len(i) and not all(want)


def test_entries_packed_and_unpacked():
    rng = np.random.default_rng(3)
    entries = rng.integers(0, 1 << 32, (5000, 6), dtype=np.uint32)
    entries[:, 0] = np.sort(rng.integers(0, 900, 5000, dtype=np.uint32))
    assert (linedups.unpack(linedups.pack(entries)) == entries).all() and len(linedups.pack(entries)) < 22 * 5000


def _changed(rng, line, share):
    """The line with one letter in every 1 / share replaced at most, one at least."""
    other = list(line)
    for _ in range(rng.randint(1, max(1, int(len(line) * share)))):
        other[rng.randrange(len(other))] = rng.choice("qrstuv")
    return "".join(other).upper() if rng.random() < 0.3 else "".join(other)


def _line_recall(spark, lines, **settings):
    """The share of alike pairs that are joined; all that is joined must be connected by alike pairs."""
    docs = ["\n".join(lines[i : i + 5]) for i in range(0, len(lines), 5)]
    got = {(r["doc_id"], r["line"]): (r["kept_doc_id"], r["kept_line"]) for r in linedups.repeated_lines(frame(spark, docs), **settings).collect()}
    forms = [linedups.normal(x.lower()) for x in lines]
    place = lambda i: (i // 5, i % 5)
    longest = lambda i, j: max(len(forms[i]), len(forms[j]))
    near = [(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if abs(len(forms[i]) - len(forms[j])) <= 0.05 * longest(i, j) and 1 - _myers(forms[i], forms[j]) / longest(i, j) >= linedups.SIMILARITY]
    found = sum(got.get(place(i), place(i)) == got.get(place(j), place(j)) for i, j in near)
    nodes, roots = graph.label(np.array([i for i, _ in near]), np.array([j for _, j in near]))
    roots = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    at = {place(i): i for i in range(len(lines))}
    assert all(roots[i] == roots[at[got[place(i)]]] for i in range(len(lines)) if place(i) in got)
    return len(near), found


@pytest.mark.parametrize("seed", [12, 13, 14, 15, 16])
def test_lines_against_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = []
    for _ in range(200):
        base = sentence(rng, rng.randint(4, 40))
        lines.append(base)
        lines += [_changed(rng, base, 1 / 30) for _ in range(rng.randint(0, 2))]
    rng.shuffle(lines)
    near, found = _line_recall(spark, lines)
    assert near > 60 and found >= 0.9 * near


def test_lines_of_scripts_without_spaces(spark):
    rng = random.Random(18)
    lines = []
    for low, high in ((0x4E00, 0x9FA0), (0x3041, 0x3096), (0xE01, 0xE2F)):
        for _ in range(30):
            base = [chr(rng.randint(low, high)) for _ in range(rng.randint(30, 300))]
            lines.append("".join(base))
            base[rng.randrange(len(base))] = chr(low)
            lines.append("".join(base) + "。")
    near, found = _line_recall(spark, lines)
    assert near >= 85 and found >= 0.9 * near


def test_large_families_of_lines(spark):
    rng = random.Random(17)
    lines, base = [], sentence(rng, 30)
    while len(lines) < 120:  # a chain: each form is alike to the one before it, the last not to the first
        base = _changed(rng, base, 1 / 60).lower()
        lines.append(base)
    near, found = _line_recall(spark, lines, family=8, chunk=16)
    assert near > 200 and found == near


@pytest.mark.parametrize("length", [20, 30, 60, 120, 400, 800])
@pytest.mark.parametrize("share", [0.01, 0.03, 0.045])
def test_blocks_of_many_forms(length, share):
    # Widths as of four million forms of one band; the brute-force tests above have narrow blocks.
    rng = random.Random(length)
    bases = [sentence(rng, length // 5 + 1)[:length].rstrip() + "a" for _ in range(400)]
    others = ["".join(rng.choice("qrstuv") if i in at else c for i, c in enumerate(x)) for x in bases for at in [set(rng.sample(range(len(x)), max(1, int(len(x) * share))))]]
    pairs = [(x, y) for x, y in zip(bases, map(linedups.normal, others), strict=True) if _myers(x, y) <= linedups.most_edits(max(len(x), len(y)), linedups.SIMILARITY)]
    raw = np.frombuffer("\n".join(z for p in pairs for z in p).encode(), dtype=np.uint8)
    found, begins, _, _ = linedups.line_words(raw, np.array([0, len(raw)]))
    letters = np.flatnonzero(found.inside)
    first = np.searchsorted(letters, np.append(begins, len(raw)))
    sig = linedups.simhashes(linedups._CLASS[raw[letters]], first, np.arange(2 * len(pairs)))
    keys = linedups.block_keys(np.stack(linedups.columns(sig)[: linedups.WORDS], axis=1).view(np.uint64), 20, *linedups.block_plan(1 << 22))
    check = sig[:, 2 * linedups.WORDS :]
    met = (keys[::2] == keys[1::2]).any(axis=1) & linedups._near(check[::2], check[1::2])
    assert len(pairs) > 150 and met.mean() >= (0.9 if length > 20 else 0.75), met.mean()


@pytest.mark.parametrize("length", [20, 30, 60, 120, 400, 800])
@pytest.mark.parametrize("share", [0.01, 0.03, 0.045])
def test_candidates_of_changed_lines(length, share):
    # With the bytes of the check bits, which test_blocks_of_many_forms leaves out.
    rng = random.Random(length + 1)
    bases = [sentence(rng, length // 5 + 1)[:length].rstrip() + "a" for _ in range(400)]
    others = ["".join(rng.choice("qrstuv") if i in at else c for i, c in enumerate(x)) for x in bases for at in [set(rng.sample(range(len(x)), max(1, int(len(x) * share))))]]
    pairs = [(x, y) for x, y in zip(bases, map(linedups.normal, others), strict=True) if _myers(x, y) <= linedups.most_edits(max(len(x), len(y)), linedups.SIMILARITY)]
    raw = np.frombuffer("\n".join(z for p in pairs for z in p).encode(), dtype=np.uint8)
    found, begins, _, _ = linedups.line_words(raw, np.array([0, len(raw)]))
    letters = np.flatnonzero(found.inside)
    first = np.searchsorted(letters, np.append(begins, len(raw)))
    met = _candidate_pairs(linedups.simhashes(linedups._CLASS[raw[letters]], first, np.arange(2 * len(pairs))), 1)
    recall = sum((2 * i, 2 * i + 1) in met for i in range(len(pairs))) / len(pairs)
    assert recall >= (0.9 if length > 20 else 0.75), recall


def _candidate_pairs(sig, parts, family=linedups.FAMILY):
    """The candidates, as pairs of row numbers, that the tasks of so many parts find among SimHashes of one length."""
    n = len(sig)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, 100, np.int32)), *map(pa.array, linedups.columns(sig))], ["h", "size", *linedups._SIGS])
    blocked = pa.Table.from_batches(linedups._blocked(linedups.SIMILARITY, parts)(iter([batch])))
    tasks = [blocked.filter(pa.compute.equal(blocked.column("part"), p)).to_batches() for p in range(parts)]
    return {(r["b"], r["a"]) for t in tasks for found in linedups._candidates(family)(iter(t)) for r in found.to_pylist()}


def _turned(rng, sig, share):
    """The SimHashes with each bit turned by the chance ``share``."""
    bits = np.unpackbits(np.ascontiguousarray(sig).view(np.uint8), axis=1)
    return np.packbits(bits ^ (rng.random(bits.shape) < share), axis=1).view(np.uint32)


def test_candidates_whatever_the_other_forms():
    rng = np.random.default_rng(6)
    own = rng.integers(0, 1 << 32, (400, 9), dtype=np.uint32)
    own = np.concatenate([own, _turned(rng, own, 0.1)])
    alone = _candidate_pairs(own, 1)
    assert sum((i, i + 400) in alone for i in range(400)) > 340
    many = _candidate_pairs(np.concatenate([own, rng.integers(0, 1 << 32, (40_000, 9), dtype=np.uint32)]), 3)
    assert {(i, j) for i, j in many if j < 800} == alone
    assert linedups.block_plan(1 << 8) == linedups.block_plan(1 << 26)


def test_candidates_by_their_definition():
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 32, (6, 9), dtype=np.uint32)
    sig = _turned(rng, np.repeat(centres, 50, axis=0), 0.06)
    wide = np.stack(linedups.columns(sig)[:-1], axis=1).view(np.uint64)
    sketches = linedups.Sketches(wide, linedups.columns(sig)[-1].view(np.uint32), np.full(len(sig), 100), linedups.SIMILARITY)
    want = {(i, int(j)) for i in range(len(sig)) for j in np.flatnonzero(sketches.candidates(i, np.arange(len(sig)))) if i < j}
    assert len(want) > 1000 and _candidate_pairs(sig, 2) == want and _candidate_pairs(sig, 1) == want


def test_families_are_not_listed_pair_by_pair():
    # All 1,279,200 pairs of a family of 1,600 forms are near; few of them are listed, and still join all of its forms.
    rng = np.random.default_rng(8)
    sig = _turned(rng, np.repeat(rng.integers(0, 1 << 32, (1, 9), dtype=np.uint32), 1600, axis=0), 0.03)
    listed = np.array(sorted(_candidate_pairs(sig, 2)))
    nodes, roots = graph.label(listed[:, 0], listed[:, 1])
    assert len(nodes) == len(sig) and not roots.any() and len(listed) < 120 * len(sig)


def test_groups_of_a_family_against_brute_force():
    rng = random.Random(21)
    bases = [sentence(rng, 25)]
    bases += ["".join(rng.choice("qrstuv") if rng.random() < 0.05 else c for c in bases[0]) for _ in range(40)]
    forms = sorted({linedups.normal(_changed(rng, rng.choice(bases), 0.03).lower()) for _ in range(300)})
    raw = np.frombuffer("\n".join(forms).encode(), dtype=np.uint8)
    found, begins, _, _ = linedups.line_words(raw, np.array([0, len(raw)]))
    letters = np.flatnonzero(found.inside)
    wide = linedups.columns(linedups.simhashes(linedups._CLASS[raw[letters]], np.searchsorted(letters, np.append(begins, len(raw))), np.arange(len(forms))))
    sketches = linedups.Sketches(np.stack(wide[:-1], axis=1).view(np.uint64), wide[-1].view(np.uint32), np.array(list(map(len, forms))), linedups.SIMILARITY)
    alike = lambda i, j: _myers(forms[i], forms[j]) <= linedups.most_edits(max(len(forms[i]), len(forms[j])), linedups.SIMILARITY)
    want = np.array([(i, j) for i in range(len(forms)) for j in np.flatnonzero(sketches.candidates(i, np.arange(len(forms)))).tolist() if i < j and alike(i, j)])
    edges = np.array(list(linedups.line_groups(pa.array(forms), sketches, linedups.SIMILARITY)))
    assert all(alike(i, j) for i, j in edges.tolist()) and len(edges) < len(forms) <= len(want)
    assert [x.tolist() for x in graph.label(*edges.T)] == [x.tolist() for x in graph.label(*want.T)] and len(set(graph.label(*want.T)[1].tolist())) > 1


def test_groups_of_families_and_of_pairs(spark):
    rng = random.Random(19)
    lines = []
    for _ in range(6):
        base = sentence(rng, 12)
        lines += [_changed(rng, base, 0.06) for _ in range(40)]
    docs = frame(spark, ["\n".join(lines[i : i + 5]) for i in range(0, len(lines), 5)])
    pairs, families = (sorted(map(tuple, linedups.repeated_lines(docs, family=n, chunk=16).collect())) for n in (linedups.FAMILY, 4))
    assert len(pairs) > 60 and pairs == families


def test_line_numbers_and_rebuilt_texts(spark):
    docs = ["Alpha beta gamma delta.\n\nOnly here one\n", "alpha  BETA gamma, delta\nsomething else entirely", "ALPHA beta gamma delta\nalpha beta gamma delta!"]
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in linedups.without_repeats(frame(spark, docs)).collect()}
    assert left == {0: (docs[0], len(docs[0])), 1: ("something else entirely", 23)}


def test_simhash_by_its_definition():
    rng = random.Random(5)
    lines = [sentence(rng, n).encode() for n in (1, 9, 300)]
    raw = np.frombuffer(b"".join(lines), dtype=np.uint8)
    first = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
    got = linedups.simhashes(linedups._CLASS[raw], first, np.array([0, 2]))
    for row, line in enumerate((lines[0], lines[2])):
        features = np.zeros((linedups.CLASSES, linedups.WAVES))
        for i, c in enumerate(line):
            features[linedups._CLASS[c]] += linedups._WAVE[i * linedups.PLACES // len(line)]
        sums = features.reshape(-1) @ linedups._PLANES
        bits = np.unpackbits(got[row].view(np.uint8))
        assert (bits == (sums > 0))[np.abs(sums) > 1e-3].all()


# 3

def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 32))
    near = np.concatenate([base[i] + rng.normal(size=(3, 32)) * s for i, s in zip(range(60), itertools.cycle([0.02, 0.1, 0.2]))])
    x = np.concatenate([base, near])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["duplicate_of"] for r in itq.near_vectors(df).collect()}
    i, j = np.nonzero(np.triu(x @ x.T >= itq.SIMILARITY, 1))
    nodes, roots = graph.label(i, j)
    want = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    pairs = list(zip(i.tolist(), j.tolist(), strict=True))
    assert len(pairs) > 150 and sum(got.get(a, a) == got.get(b, b) for a, b in pairs) >= 0.95 * len(pairs)
    assert all(want[a] == want[b] for a, b in got.items())


@pytest.mark.parametrize("offset", [0.8, 0.9])
def test_vectors_with_a_shared_offset(spark, offset):
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(offset * unit(rng.normal(size=(1, 64))) + np.sqrt(1 - offset**2) * unit(rng.normal(size=(2000, 64))))
    near = itq.moved(base[:400], 0.955, 1)[0]
    x = np.concatenate([base, near])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["duplicate_of"] for r in itq.near_vectors(df).collect()}
    assert sum(got.get(a, a) == got.get(2000 + a, 2000 + a) for a in range(400)) >= 0.9 * 400


@pytest.mark.parametrize("offset", [0.0, 0.8, 0.9])
def test_tables_of_many_vectors(offset):
    # Tables of 22 bits, as of four million vectors: two of them make up the code, before the only ones.
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(offset * unit(rng.normal(size=(1, 64))) + np.sqrt(1 - offset**2) * unit(rng.normal(size=(4000, 64))))
    mean, turned = base.mean(axis=0), np.linalg.qr(rng.normal(size=(64, 64)))[0]
    apart = lambda x, seed: np.stack([itq.codes(x, mean, turned) ^ itq.codes(y, mean, turned) for y in itq.moved(x, itq.SIMILARITY, seed)], axis=1).byteswap()
    places = itq.table_bits(64, 22)
    tables, radius, check = itq.chosen(apart(base[:2000], 1), places)
    new = apart(base[2000:], 2)[:, 0]
    met = np.zeros(len(new), dtype=bool)
    for row in places[:tables]:
        met |= np.bitwise_count(new & np.uint64(sum(1 << (63 - int(i)) for i in row))) <= radius
    assert (met & (np.bitwise_count(new) <= check)).mean() >= 0.9


def test_supersets_meet():
    for a, b in itertools.product(range(64), repeat=2):
        meet = set.intersection(*({int(v[0]) for r, v in itq.supersets(np.array([x], dtype=np.uint64), 6, 2) if len(r)} for x in (a, b)))
        if (a ^ b).bit_count() <= 2:
            assert meet


# 4

def test_mixing_budgets(spark):
    rng = random.Random(4)
    texts = [sentence(rng, rng.randint(0, 30)) for _ in range(300)]
    docs = frame(spark, texts, [rng.choice(["big", "big", "big", "small"]) for _ in texts])
    size = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
    rows = mixing.mix(docs, {"big": 1.0, "small": 3.0}, total=6001).collect()
    taken = {s: sum(r["taken"] for r in rows if r["source"] == s) for s in ("big", "small")}
    assert taken == {"big": 1500, "small": 4500}
    for s in taken:
        own = [r for r in rows if r["source"] == s]
        last = max(r["epoch"] for r in own)
        assert sum(r["taken"] < r["tokens"] for r in own) <= 1 and all(r["epoch"] == last for r in own if r["taken"] < r["tokens"])
        # By brute force: the hashed order, from its beginning, epoch after epoch.
        import hashlib

        order = sorted((r["doc_id"] for r in docs.where(F.col("source") == s).collect()), key=lambda i: hashlib.md5(f"mix-1:{i}".encode()).hexdigest())
        left, want = taken[s], []
        for epoch in itertools.count(1):
            for i in order:
                if left > 0 and size[i]:
                    want.append((i, epoch, min(left, size[i])))
                    left -= size[i]
            if left <= 0:
                break
        assert sorted((r["doc_id"], r["epoch"], r["taken"]) for r in own if r["tokens"]) == sorted(want)
    whole = mixing.mixed_documents(docs, {"big": 1.0, "small": 3.0}, total=6001).groupBy("doc_id").count().collect()
    draws = {}
    for r in rows:
        draws[r["doc_id"]] = draws.get(r["doc_id"], 0) + 1
    assert {r["doc_id"]: r["count"] for r in whole} == draws


# 5

def _maximal_segments(scores):
    """By the definition: the best segment, then the same on both sides of it."""
    best, at = 0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > best or s == best and at and j - i < at[1] - at[0]:
                best, at = s, (i, j)
    if at is None:
        return []
    left = _maximal_segments(scores[: at[0]])
    right = [(s, b + at[1], e + at[1]) for s, b, e in _maximal_segments(scores[at[1] :])]
    return [*left, (best, *at), *right]


def test_segments():
    rng = random.Random(9)
    for _ in range(400):
        scores = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        got = toxicity.segments(np.array(scores))
        want = _maximal_segments(scores)
        assert [(round(s, 6), b, e) for s, b, e in got] == [(round(s, 6), b, e) for s, b, e in want]


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(10)
    clean = [sentence(rng, 1).lower() for _ in range(300)]
    foul = ["zzfoul", "zzvile", "zzgrim", "zzdire"]
    texts, toxic = [], []
    for i in range(400):
        w = [rng.choice(clean) for _ in range(rng.randint(30, 200))]
        bad = i % 4 == 0
        if bad:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(foul) for _ in range(6)]
        texts.append(" ".join(w))
        toxic.append(bad)
    docs = frame(spark, texts)
    known = spark.createDataFrame([(i, int(toxic[i])) for i in range(200)], "doc_id long, toxic int")
    worst = " ".join(clean[:40] + foul * 3)
    odd = frame(spark, [worst, worst, worst, None, "", worst + " " + " ".join(clean * 200)], ids=[None, 900, 900, 901, 902, 903])
    every = toxicity.toxic_documents(docs.union(odd).withColumn("least", F.lit(1)).withColumn("toxic", F.lit(0)), known).collect()
    rows = [r for r in every if r["doc_id"] is not None and r["doc_id"] < 900]
    assert sorted((r["doc_id"] for r in every if r not in rows), key=str) == [900, 900, 903, None]
    held = {r["doc_id"] for r in rows if r["doc_id"] >= 200}
    want = {i for i in range(200, 400) if toxic[i]}
    assert len(held & want) >= 0.95 * len(want) and len(held - want) <= 2
    for r in rows:
        for p in r["passages"]:
            assert any(w in foul for w in texts[r["doc_id"]].split()[p["begin"] : p["end"]])
    assert {r["doc_id"] for r in toxicity.clean_documents(docs, known).collect()} == set(range(400)) - {r["doc_id"] for r in rows}


def test_toxic_words_that_lie_apart():
    # Ten segments of a score that is expected once in twenty such texts; before, only the best one counted.
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), 3.5, 0.005)
    apart = [0.75] * 10
    assert -np.expm1(-model.expected(0.75, 700)) > 0.1 and model.combined(apart, 700)[0] < toxicity.SIGNIFICANCE
    assert model.combined(apart[:1], 700)[0] > 0.1 and model.combined([], 700) == (1.0, 0)


def test_sum_of_segments_tail():
    sums = np.cumsum(-np.log(np.cumsum(np.random.default_rng(0).exponential(size=(200_000, 6)), axis=1)), axis=1)
    for r, t in itertools.product((1, 2, 3, 6), (1.0, 2.5, 5.5)):
        assert abs(toxicity.sum_tail(r, t) - (sums[:, r - 1] >= t).mean()) < 0.004
    assert all(0 <= toxicity.sum_tail(r, t + 7) <= toxicity.sum_tail(r, t) <= 1 for r in (1, 2, 9, 32) for t in (-50.0, 0.5, 150.0, 900.0))


# 6

def test_suffix_array():
    rng = random.Random(1)
    for _ in range(1500):
        n, a = rng.randint(0, 50), rng.choice([1, 2, 3, 20])
        t = [rng.randint(1, a) for _ in range(n)]
        t = (t[:6] * 9)[:n] if rng.random() < 0.3 else t
        t = [*t, 0]
        assert suffixes.suffix_array(np.array(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    assert suffixes.suffix_array(np.array([], dtype=np.int64)).tolist() == []


def _passages(texts, length=50):
    """By brute force over all windows."""
    where = {}
    words = [WORD.findall(t.lower()) for t in texts]
    for d, w in enumerate(words):
        for i in range(len(w) - length + 1):
            where.setdefault(tuple(w[i : i + length]), set()).add(d)
    out = set()
    for d, w in enumerate(words):
        for kept in (True, False):
            at = [i for i in range(len(w) - length + 1) if len(o := where[tuple(w[i : i + length])]) > 1 and (min(o) == d) == kept]
            for i in at:
                if i == at[0] or i > before + length:  # noqa: F821
                    begin = i
                before = i
                if i == at[-1] or at[at.index(i) + 1] > i + length:
                    out.add((d, begin, i + length, kept))
    return out


def test_passages_against_brute_force(spark):
    rng = random.Random(13)
    shared = [sentence(rng, n) for n in (49, 50, 51, 60, 90, 200)]
    texts = []
    for _ in range(60):
        parts = [sentence(rng, rng.randint(0, 40)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, 3), rng.choice(shared))
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3], texts[5] + " tail", "w " * 300, "w " * 200, " ".join(shared)]
    got = {(r["doc_id"], r["begin"], r["end"], r["kept"]) for r in passages.repeated_passages(frame(spark, texts)).collect()}
    assert got == _passages(texts)


# 7

def test_ledger_scans_only_what_is_new(spark, tmp_path):
    key, token = "AKIA" + "A1B2C3D4E5F6G7H8", "ghp_" + "a" * 36
    docs = frame(spark, [f"my {key} and {key}", "nothing", f"x={token}", f"x={token}"])
    ledger = secrets.Ledger(spark, str(tmp_path))
    first = {(r["doc_id"], r["rule"], r["nth"]) for r in ledger.scan(docs).collect()}
    assert first == {(0, "aws_access_key", 0), (0, "aws_access_key", 1), (2, "github_token", 0), (3, "github_token", 0)}
    assert ledger.scanned().count() == 3 * len(secrets.RULES)
    more = docs.union(frame(spark, [f"late {token}"], ids=[9]))
    assert {r["doc_id"] for r in ledger.scan(more).collect()} == {0, 2, 3, 9}
    assert ledger.scanned().count() == 4 * len(secrets.RULES)
    assert secrets.scan_blobs(secrets.versions(more), scanned=ledger.scanned()).count() == 0
    newer = tuple(secrets.Rule(r.name, 2, r.pattern, r.literals) if r.name == "github_token" else r for r in secrets.RULES)
    assert {(r["doc_id"], r["rule_version"]) for r in ledger.scan(more, newer).collect()} == {(0, 1), (2, 2), (3, 2), (9, 2)}
    assert {tuple(r) for r in secrets.scan_secrets(docs).collect()} == {tuple(r) for r in ledger.scan(docs).collect()}


def test_secrets_of_awkward_rows(spark):
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    rows = [(None, key, "en", "s", 1), (1, key, "en", None, 1), (1, key, None, "en", 1), (1, key, None, "en", 1), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, "word " * 50_000 + key, "en", "s", 1)]
    found = secrets.scan_secrets(spark.createDataFrame(rows, DOCS).withColumn("place", F.lit(1)).withColumn("hits", F.lit(2))).collect()
    assert sorted((r["path"], r["rule"], r["nth"]) for r in found) == [(p, "aws_access_key", 0) for p in ("/en/1", "en//1", "s/en/", "s/en/4")]


def test_assigned_secrets(spark):
    texts = ['DB_PASSWORD="hunter2hunter2"', "client_secret = 'abcdefgh12'", '{"password": "s3cr3ts3cr3t"}', 'token = "c044c15f39d0"', 'the token: "short"', "a secret = nothing quoted"]
    found = {r["doc_id"] for r in secrets.scan_secrets(frame(spark, texts)).collect() if r["rule"] == "assigned_secret"}
    assert found == {0, 1, 2, 3}


# 8

def _least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        n, room = 1, mid
        for s in sizes:
            if s > room:
                n, room = n + 1, mid
            room -= s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 2, 5, 40, 500])
def test_shards_against_brute_force(spark, shards):
    rng = random.Random(shards)
    texts = ["x" * (rng.choice([0, 1, 5, 30, 400])) for _ in range(200)]
    rows = sorted(tuple(r) for r in sharding.shard(frame(spark, texts), shards=shards).collect())
    assert [r[:2] for r in rows] == [(i, len(t)) for i, t in enumerate(texts)]
    loads = {}
    for _, size, s in rows:
        loads[s] = loads.get(s, 0) + size
    assert [r[2] for r in rows] == sorted(r[2] for r in rows) and len(loads) <= shards
    assert max(loads.values()) == _least_capacity([len(t) for t in texts], shards)


# 9

def test_sketches(spark):
    rng = random.Random(14)
    words = sentence(rng, 3000).split()
    texts = [" ".join(words), " ".join(words[:1500]), " ".join(words[750:2250]), "two words", "a b c d e", ""]
    rows = {r["doc_id"]: r for r in sketch.fingerprints(frame(spark, texts), size=512).collect()}
    for i in (0, 1, 2):
        assert abs(rows[i]["distinct_shingles"] / len(_shingles(texts[i])) - 1) < 0.15
    assert rows[3]["distinct_shingles"] == 1 and rows[4]["distinct_shingles"] == 3 and rows[5]["sketch"] == []
    df = spark.createDataFrame([(rows[0]["sketch"], rows[1]["sketch"], rows[2]["sketch"])], "a array<long>, b array<long>, c array<long>")
    got = df.select(sketch.resemblance(F.col("b"), F.col("c"), 512).alias("r"), sketch.containment(F.col("b"), F.col("a"), 512).alias("in"), sketch.containment(F.col("a"), F.col("b"), 512).alias("half")).first()
    assert abs(got["r"] - 1 / 3) < 0.08 and got["in"] > 0.85 and abs(got["half"] - 0.5) < 0.1
    halves = spark.createDataFrame([(1, " ".join(words[:1502])), (1, " ".join(words[1500:])), (2, "")], "k long, text string")
    merged = {r["k"]: r for r in sketch.merge_parts(sketch.part_sketches(halves, "k", "text", 512).withColumnRenamed("doc_id", "k"), "k", 512).collect()}
    assert merged[1]["sketch"] == rows[0]["sketch"] and merged[1]["shingles"] == rows[0]["shingles"] and merged[2]["sketch"] == []


def test_registered_sketches_against_brute_force(spark):
    rng = random.Random(19)
    texts = [sentence(rng, n) for n in (0, 1, 2, 3, 65, 66, 67, 400, 3000)] + [None, "中国語 " * 40]
    for r in sketch.fingerprints(frame(spark, texts)).collect():
        column = V.strings(pa.array([texts[r["doc_id"]]], pa.string()))
        every = set().union(*(V.shingles(V.words(raw, offsets), sketch.SHINGLE)[0].tolist() for _, raw, offsets in V.slices(column)))
        assert r["sketch"] == [x - (1 << 63) for x in sorted(every)[: sketch.SIZE]]
        if len(every) < sketch.SIZE:
            assert r["distinct_shingles"] == len(every)


# 10

def test_best_fit():
    rng = random.Random(15)
    for _ in range(60):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(0, 60))]
        bins = packing.best_fit(sizes, 20)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        loads, want = [sum(sizes[i] for i in b) for b in bins], []
        for s in sorted(sizes, reverse=True):
            room = [(20 - w - s, k) for k, w in enumerate(want) if w + s <= 20]
            if room:
                want[min(room)[1]] += s
            else:
                want.append(s)
        assert max(loads, default=0) <= 20 and sorted(loads) == sorted(want)


def test_packing_tree(spark):
    rng = random.Random(16)
    texts = [" ".join("w" * 1 for _ in range(rng.choice([1, 3, 40, 64, 65, 90, 200]))) for _ in range(900)]
    rows = packing.pack(frame(spark, texts), capacity=64, leaf_items=50).collect()
    seen = {}
    for r in rows:
        assert r["tokens"] == sum(r["lengths"]) <= 64
        for d, b, n in zip(r["doc_ids"], r["begins"], r["lengths"], strict=True):
            seen.setdefault(d, []).append((b, n))
    for i, t in enumerate(texts):
        at = 0
        for b, n in sorted(seen[i]):
            assert b == at
            at += n
        assert at == len(t.split())
    pieces = [n for d in seen for _, n in seen[d]]
    assert len(rows) <= 1.02 * len(packing.best_fit(pieces, 64)) + 1
    assert len({r["bin_id"] for r in rows}) == len(rows)


def test_bins_of_repeated_documents(spark):
    texts = [" ".join("w" for _ in range(n)) for n in (200, 200, 64, 64, 40, 40, 30, 30, 128, 128)]
    rows = packing.pack(frame(spark, texts, ids=[1, 1, 2, 2, 3, 3, None, None, None, None]), capacity=64).collect()
    assert sum(r["tokens"] for r in rows) == sum(len(t.split()) for t in texts)
    assert len({r["bin_id"] for r in rows}) == len(rows)
