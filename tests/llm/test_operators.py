"""Each operator next to a brute-force version, on texts with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from punctual.llm import (
    backoff, components, decontamination, licenses, packing, pivots, sentence_spans, simhash, substrings, token_files,
    toxicity,
)
from punctual.llm.tokens import Tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASHING = "doc_id long, text string, found string, score string, row string, part string, bits string, spans string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(seed, sentences=6):
    pick = random.Random(seed)
    words = "the of and quick brown fox über naïve señor jumps over lazy dogs while it rains in May".split()
    return " ".join(
        " ".join(pick.choice(words) for _ in range(pick.randint(3, 14))).capitalize() + "." for _ in range(sentences)
    )


PASSAGE = prose(99, 8)
TEXTS = [
    (1, prose(1)), (2, prose(2) + " " + PASSAGE + "\n" + prose(3)), (3, PASSAGE + " " + prose(4)), (4, None), (5, ""),
    (6, "   \n\t "), (7, prose(1)), (7, prose(1)), (8, prose(5, 400)), (9, "one"), (10, "one"), (None, prose(1)),
    (11, "a" * 1000), (12, "!!! ??? ..."), (13, "éa ÉA Éa " * 60), (14, PASSAGE.upper()), (15, "x\0y \r\n z  q  r "),
    (16, prose(6) + " <|endoftext|> " + prose(7)),
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "docs")
    rows = [(i, t, *["x"] * 6) for i, t in TEXTS]
    spark.createDataFrame(rows, CLASHING).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], CLASHING)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- tokens ------------------------------------------------------------------
@pytest.mark.parametrize("table_bytes", [0, 20_000, 1 << 26])
def test_pieces_give_the_tokenizers_ids(table_bytes):
    import pyarrow as pa

    coder, pick = Tokens(BPE, table_bytes), random.Random(3)
    odd = ["".join(pick.choice(" \n\t\ra1!é ' Ċ") for _ in range(pick.randint(0, 9))) for _ in range(2000)]
    texts = [t or "" for _, t in TEXTS] + odd
    pick.shuffle(texts)
    # Several calls, so that pieces are met again after a half of the table went.
    for at in range(0, len(texts), 300):
        some = [*texts[at : at + 300], None]
        ids, sizes = coder.encode(pa.array(some))
        ends = np.cumsum(sizes)
        for text, a, b in zip(some, ends - sizes, ends):
            assert ids[a:b].tolist() == [*coder.whole(text or ""), 0], text
        assert (coder.count(pa.array(some)) == sizes - 1).all()
    assert len(coder.count(pa.array([], pa.string()))) == 0


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], list(range(3000)), [0, 1 << 60], [3, 3, 900, 900, 1 << 40]])
def test_elias_fano(values):
    code = token_files.EliasFano.of(np.array(values, np.uint64))
    again = token_files.EliasFano.read(code.n, code.low_bits, code.blocks())
    assert again.all().tolist() == values == [again.select(i) for i in range(len(values))]
    with pytest.raises(IndexError):
        again.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    size = sum(map(len, token_files.EliasFano.of(ends).blocks()))
    assert size * 8 / 100_000 < 2 + np.log2(1000) + 1


def test_token_files(spark, docs):
    coder = Tokens(BPE)
    got = rows(token_files.encode_to_files(docs, BPE, file_ids=500).select("doc_id", "start", "n_tokens", "ids_crc32"))
    by_start = sorted(got, key=lambda r: r[1])
    ids = [None if r[0] is None else r[0] for r in by_start]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert [r[1] for r in by_start] == [0, *np.cumsum([r[2] for r in by_start])[:-1].tolist()]
    want = Counter()
    for i, text in TEXTS:
        own = np.array([*coder.whole(text or ""), 0], "<u4")
        want[i, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r[0], r[2], r[3]) for r in got) == want


def test_token_file_gives_single_documents():
    ids, sizes, keys = np.arange(10), np.array([3, 0, 7]), [None, -5, 70]
    one = token_files.TokenFile(b"".join(token_files.pack_file(ids, sizes, keys, 2)))
    assert one.doc_ids() == keys == [one.doc_id(i) for i in range(3)]
    assert [one.document(i).tolist() for i in range(3)] == [[0, 1, 2], [], list(range(3, 10))]
    with pytest.raises(ValueError):
        token_files.TokenFile(b"something else")


def test_ids_that_do_not_fit_raise_an_error():
    ids = np.array([1, 70_000])
    with pytest.raises(ValueError):
        token_files.pack_file(ids, np.array([2]), [1], 2)
    one = token_files.TokenFile(b"".join(token_files.pack_file(ids, np.array([2]), [1], 4)))
    assert one.document(0).tolist() == [1, 70_000]


def test_no_token_files(none):
    assert rows(token_files.encode_to_files(none, BPE)) == []


# --- decontamination ---------------------------------------------------------
ITEMS = [(1, PASSAGE), (2, PASSAGE), (3, "one"), (4, None), (5, "... !"), (6, prose(7)), (None, prose(5, 3)), (7, "Naïve, DOGS")]


def brute_hits(texts, items, window=10):
    patterns = {}
    for item, text in items:
        words = WORD.findall(lowered(text))
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            patterns.setdefault(tuple(words[i : i + n]), set()).add(item)
    out = []
    for doc, text in texts:
        words, hit, found = WORD.findall(lowered(text)), set(), set()
        for n in {len(p) for p in patterns}:
            for i in range(len(words) - n + 1):
                if own := patterns.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own - {None}
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, docs, block_bytes):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontamination.find(docs, benchmark, block_bytes=block_bytes, column="__found")
    assert rows(decontamination.digest(found, "__found")) == brute_hits(TEXTS, ITEMS)
    assert set(docs.columns) < set(found.columns)


def test_decontamination_without_rows(spark, docs, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert rows(decontamination.digest(decontamination.find(docs, empty))) == brute_hits(TEXTS, [])
    assert rows(decontamination.find(none, spark.createDataFrame(ITEMS, "item_id long, text string"))) == []


# --- substrings --------------------------------------------------------------
def brute_strings(texts, length):
    data = [(d, (t or "").encode()) for d, t in texts]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, anchor, hot", [(200, 80, 50_000), (200, 80, 2), (31, 8, 50_000), (16, 16, 3)])
def test_substrings(docs, length, anchor, hot):
    got = substrings.remove_repeats(docs, length, anchor, hot)
    got = got.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.col("kept"))
    assert rows(got.withColumn("kept", F.col("kept"))) == brute_strings(TEXTS, length)


def test_substrings_over_chunks_and_ranges(spark, tmp_path, monkeypatch):
    from punctual.llm import packed

    pick = random.Random(5)
    texts = [(i, "".join(pick.choice("ab") for _ in range(pick.randint(0, 200)))) for i in range(120)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(12).write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(substrings, "RANGE_BYTES", 1000)
    got = substrings.remove_repeats(spark.read.parquet(str(tmp_path / "d")), 14, 5)
    assert rows(got.select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept")) == brute_strings(texts, 14)


def test_no_substrings(none):
    assert rows(substrings.remove_repeats(none)) == []


# --- SimHash -----------------------------------------------------------------
def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    own = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    prints = {(i, f"{brute_print(t):016x}") for i, t in TEXTS}
    assert set(got) == prints
    same = {}
    for i, p in prints:
        if i is not None:
            same.setdefault(p, []).append(i)
    for (i, p), component in got.items():
        assert component == (None if i is None else min(same[p]))


@pytest.mark.parametrize("bucket", [64, 3, 0])
def test_fingerprint_links(spark, bucket):
    pick = random.Random(8)
    prints = {0, 1, 3, 7, (1 << 64) - 1}
    for _ in range(60):
        base = pick.getrandbits(64)
        prints |= {base ^ sum(1 << b for b in pick.sample(range(64), pick.randint(0, 3))) for _ in range(6)}
    # Many that agree in a part.
    prints |= {pick.getrandbits(22) << 42 for _ in range(40)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "bits long"), bucket=bucket)
    found = {(min(a, b), max(a, b)) for a, b in links.collect()}

    def groups(pairs):
        root = {p: p for p in signed}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[top(a)] = top(b)
        out = {}
        for p in signed:
            out.setdefault(top(p), set()).add(p)
        return sorted(map(sorted, out.values()))

    true = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert found <= true
    assert groups(found) == groups(true)


def test_thresholds_cover_all_links():
    sample = np.random.default_rng(2).integers(0, 1 << 63, 500, dtype=np.uint64)
    for parts in (2, 3, 4, 5):
        chosen = simhash.plan(sample, 10_000, parts)
        assert sum(t for _, t in chosen) == 2 - parts + 1
        assert sorted(b for g, _ in chosen for b in g) == list(range(64))


def test_no_simhash(none):
    assert rows(simhash.near_duplicates(none)) == []


def test_components(spark):
    pick = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)]
    edges += [(pick.randint(1000, 1200), pick.randint(1000, 1200)) for _ in range(90)] + [(7, 7), (None, 3), (9, 8), (9, 8)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: top(x) for x in root}


# --- vectors -----------------------------------------------------------------
def brute_links(vectors, least=0.9):
    good = [
        i for i, (v, x) in enumerate(vectors)
        if v is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)
    ]
    number, root = Counter(), {v: v for v, _ in vectors}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(good):
        for j in good[n + 1 :]:
            (v, x), (w, y) = vectors[i], vectors[j]
            same_id = v == w
            if len(x) == len(y):
                x, y = np.array(x, np.float64), np.array(y, np.float64)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    number[i] += 1
                    number[j] += 1
                    same_id = True
            if same_id:
                a, b = top(v), top(w)
                root[max(a, b)] = min(a, b)
    return sorted(((v, number[i], None if v is None else top(v)) for i, (v, _) in enumerate(vectors)), key=str)


def test_vectors(spark):
    make = np.random.default_rng(6)
    vectors = []
    for group in range(25):
        base = make.normal(size=16)
        vectors += [(len(vectors) + k, (base + make.normal(size=16) * 0.15).astype(np.float32).tolist()) for k in range(group % 7 + 1)]
    n = len(vectors)
    vectors += [(n, vectors[0][1]), (n + 1, vectors[0][1]), (n + 1, vectors[0][1]), (n + 2, None), (n + 3, [0.0] * 16),
                (n + 4, [float("nan")] * 16), (n + 5, [float("inf"), *[0.0] * 15]), (n + 6, [1.0, None] * 8), (n + 7, []),
                (None, vectors[0][1]), (n + 8, [1.0, 2.0]), (n + 9, [2.0, 4.0])]
    df = spark.createDataFrame([(v, x, "x", "y") for v, x in vectors], "vec_id long, embedding array<float>, code string, near string")
    got = pivots.near_duplicates(df, block=4)
    want = brute_links(vectors)
    found = rows(got.select("vec_id", "n_links", "component_id"))
    assert sum(r[1] for r in found) >= 0.9 * sum(r[1] for r in want)
    assert found == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got.collect())
    assert rows(pivots.near_duplicates(df.limit(0))) == []


@pytest.mark.parametrize("sampled", [1, 2, 5])
def test_vectors_of_a_rare_length(spark, sampled):
    make = np.random.default_rng(8)
    base = make.normal(size=3)
    vectors = [(i, make.normal(size=16).astype(np.float32).tolist()) for i in range(40)]
    vectors += [(40 + i, (base + make.normal(size=3) * 0.05).astype(np.float32).tolist()) for i in range(6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    # The sample ends with the rare length's vector number ``sampled``.
    codes = df.select("vec_id", F.xxhash64(F.col("embedding").cast("array<double>")).alias("code")).orderBy("code").collect()
    last = [n for n, r in enumerate(codes) if r.vec_id >= 40][sampled - 1]
    want = brute_links(vectors)
    assert sum(r[1] for r in want if r[0] >= 40) == 30
    assert rows(pivots.near_duplicates(df, pivots=last + 1, sample=1).select("vec_id", "n_links", "component_id")) == want


def test_recall_on_clustered_vectors(spark):
    """Many more vectors than pivots, links right above the threshold: 0.9 of them at least are found,
    and none that is not there."""
    make = np.random.default_rng(17)
    groups, size, dims = 5000, 4, 64
    base = make.normal(size=(groups, dims))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    found = {}
    for like in (0.90, 0.92, 0.95):
        # Vectors around a centre at such an angle that two of them have about this cosine.
        side = make.normal(size=(groups, size, dims)) / np.sqrt(dims)
        side -= (side * base[:, None]).sum(2, keepdims=True) * base[:, None]
        vectors = (base[:, None] + side * np.sqrt(1 / like - 1)).reshape(-1, dims).astype(np.float32)
        df = spark.createDataFrame(
            spark.sparkContext.parallelize([(i, v.tolist()) for i, v in enumerate(vectors)], 8), "vec_id long, embedding array<float>")
        got = {r.vec_id: r.n_links for r in pivots.near_duplicates(df, pivots=1024).select("vec_id", "n_links").collect()}
        unit = vectors.astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        want = np.concatenate([(unit[a : a + 2000] @ unit.T >= 0.9).sum(1) - 1 for a in range(0, len(unit), 2000)])
        assert all(got[i] <= n for i, n in enumerate(want.tolist()))
        found[like] = sum(got.values()) / want.sum()
    print(found)
    assert min(found.values()) >= 0.95


# --- toxicity ----------------------------------------------------------------
def test_grammar_matches_clauses():
    import pyarrow as pa

    reader = toxicity.Reader(toxicity.Grammar(words=["moron", "ekelhaft"], stems=["grot"]))
    kinds = lambda text: {k: n for k, n in zip(toxicity.MATCHES, reader.matches(pa.array([text], pa.string()))[0].tolist()) if n}
    assert kinds("What a MORON.") == {"insult": 1}
    assert kinds("You are a moron! Nice day.") == {"insult to a target": 1}
    assert kinds("You are not a moron.") == {"negated insult": 1}
    assert kinds("She was not there at all; moron") == {"insult": 1}
    assert kinds("He said it was ekelhaft.") == {"reported insult": 1}
    assert kinds("I will kill you, kill") == {"threat": 1, "threat to a target": 1}
    assert kinds("You know I will kill it") == {"threat to a target": 1}
    assert kinds("I will not kill it") == {"negated or reported threat": 1}
    assert kinds("kill the lights") == {}
    assert kinds("grotty moronic grot") == {"insult": 2}
    assert kinds("moron " * 50) == {"insult": 50}
    assert kinds(None) == kinds("") == kinds("the word") == {}


def brute_kinds(text, insults, stems):
    """Clause by clause and word by word, looking back at what was said before."""
    signs = {w: sign for sign, words in toxicity.SIGNS.items() for w in words.split()}
    out = Counter()
    for clause in re.split(r"[.!?;:\n]", (text or "").lower()):
        words = WORD.findall(clause)
        said = [toxicity.INSULT if w in insults or w.startswith(stems) else signs.get(w) for w in words]
        for i, sign in enumerate(said):
            before = set(said[:i])
            negated = toxicity.NEGATION in said[max(0, i - toxicity.REACH) : i]
            reported, target = toxicity.REPORT in before, toxicity.TARGET in before
            if sign == toxicity.INSULT:
                out["negated insult" if negated else "reported insult" if reported else "insult to a target" if target else "insult"] += 1
            elif sign == toxicity.THREAT and toxicity.MODAL in before:
                out["negated or reported threat" if negated or reported else "threat to a target" if target else "threat"] += 1
    return dict(out)


def test_grammar_equals_a_naive_parse():
    import pyarrow as pa

    pick, own = random.Random(21), ["moron", "ekelhaft", "blödmann"]
    pools = [own + toxicity.INSULTS.split(), ["grotbox", "grot", "grotté"], ["the", "word", "a1", "naïve", "it", "groß", "gro"]]
    pools += [words.split() for words in toxicity.SIGNS.values()]
    texts = [None, "", "..."] + [
        "".join(
            (w.upper() if pick.random() < 0.1 else w) + pick.choice([" ", " ", " ", " ", ", ", ". ", "! ", ";", ":", "\n", "-"])
            for w in (pick.choice(pick.choice(pools)) for _ in range(pick.randint(1, 60)))
        ) for _ in range(1500)
    ]
    reader = toxicity.Reader(toxicity.Grammar(words=own, stems=["grot"]))
    insults = {*own, *toxicity.INSULTS.split()}
    seen = Counter()
    for text, counts in zip(texts, reader.matches(pa.array(texts, pa.string())).tolist()):
        got = {k: n for k, n in zip(toxicity.MATCHES, counts) if n}
        assert got == brute_kinds(text, insults, ("grot",)), text
        seen.update(got)
    assert set(seen) == set(toxicity.MATCHES) and min(seen.values()) > 50


def test_every_further_match_adds_something():
    counts = toxicity.strength(np.arange(200))
    assert counts[0] == 0 and counts[1] == 1 and (np.diff(counts) > 0).all() and (np.diff(counts, 2) < 0).all()


def test_toxicity_learns_from_rows_not_held_out(spark, none):
    pick = random.Random(12)
    insults = ["blarg", "snorf", "quag"]
    texts, labels = [], []
    for i in range(1200):
        toxic = pick.random() < 0.15
        text = prose(i, 4)
        texts.append((i, text + (" You " + pick.choice(insults) + " " + pick.choice(insults) if toxic else "")))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (5, None), (3, 0)]
    docs = spark.createDataFrame([*texts, (5000, None), (5001, ""), (None, "You blarg")], "doc_id long, text string")
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    grammar = toxicity.learn(docs, frame)
    assert set(insults) <= set(grammar.words)
    scored = toxicity.score(docs, grammar).select("doc_id", "score", toxicity.held_out().alias("h")).collect()
    truth = dict(labels[:1200])
    held = [(r.score, truth[r.doc_id]) for r in scored if r.h and r.doc_id in truth]
    assert len(held) > 200 and all((s >= toxicity.THRESHOLD) == bool(t) for s, t in held)
    assert all(0 <= r.score <= 1 for r in scored)
    by_id = {r.doc_id: r for r in scored}
    assert by_id[5000].score == by_id[5001].score < toxicity.THRESHOLD <= by_id[None].score and not by_id[None].h
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored if r.doc_id is not None)
    # Labels of held-out rows teach nothing.
    flipped = spark.createDataFrame(
        [(i, 1 - t if i is not None and t is not None and zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels],
        "doc_id long, toxic int",
    )
    assert toxicity.learn(docs, flipped) == grammar
    assert toxicity.learn(docs, frame.limit(0)).words == []
    assert rows(toxicity.score(none, grammar)) == []


# --- licences ----------------------------------------------------------------
def test_licenses(spark, none):
    notice = licenses.TEMPLATES
    files = [
        ("a/b/1.txt", "Text.\nLicensed under the Apache License, Version 2.0.\nMore of it."), ("a/LICENSE", notice["MIT"]),
        ("a/b/2.txt", prose(1)), ("a/b/c/3.txt", prose(2)), ("d/4.txt", prose(3)), ("a/b/c/LICENCE.md", "Released under the MIT license\n" * 3),
        ("a/b/c/d/5.txt", None), ("6.txt", ""), (None, prose(4)), (None, notice["GPL-3.0"]), ("a/b/2.txt", prose(1)),
        ("e/7.txt", "This licensed cow has no licence to fly, " + prose(5)), ("f/x.txt", notice["GPL-2.0"]), ("f/g/y.txt", prose(6)),
        ("ab/8.txt", prose(7)),
    ]
    df = spark.createDataFrame([(i, p, t, "z") for i, (p, t) in enumerate(files)], "n long, path string, text string, license string")
    got = {r.n: (r.license, r.origin, r.directory) for r in licenses.scan(df, ["n"], whole_like=0.8).collect()}
    assert got[0] == ("Apache-2.0", "header", None) and got[1] == ("MIT", "header", None)
    assert got[2] == got[10] == ("MIT", "inherited", "a")
    assert got[3] == got[6] == ("MIT", "inherited", "a/b/c")
    assert got[9] == ("GPL-3.0", "header", None) and got[12] == ("GPL-2.0", "header", None)
    assert got[13] == ("GPL-2.0", "inherited", "f")
    assert all(got[i] == (None, "none", None) for i in (4, 7, 8, 11, 14)) and len(got) == len(files)
    assert rows(licenses.scan(none.withColumn("path", F.lit("a/b")), ["doc_id"])) == []


def test_licenses_in_other_forms(spark):
    gnu = "#\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {}General Public License as published by\n# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version.\n#\n"
    code = "x = 1\n\n" + prose(11) + "\n\n"
    want = [
        ("MIT", "Licensed under the MIT license"), ("MIT", "MIT License"), ("MIT", "// SPDX-License-Identifier: MIT"),
        ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
        ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"), ("CC-BY-ND-4.0", "SPDX-License-Identifier: CC-BY-ND-4.0"),
        ("GPL-1.0-or-later", "GNU GENERAL PUBLIC LICENSE"), ("GPL-3.0", gnu.format("", 3)), ("GPL-2.0", gnu.format("", 2)),
        ("LGPL-3.0", gnu.format("Lesser ", 3)), ("AGPL-3.0", gnu.format("Affero ", 3)),
        ("GPL-1.0-or-later", "it under the terms of the GNU General Public License as published by"),
        ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"),
        (None, "SPDX-License-Identifier: Foo-3.0"), (None, "Copyright 2020 the authors"), (None, "Please see the license for details"),
        (None, "he lost his driving license in May"), (None, "Licensed under the Frobnicate License, Version 7"),
    ]
    named = sorted(licenses.texts().items())
    files = [(f"src/{n}.txt", code + t + "\n\n" + prose(n)) for n, (_, t) in enumerate(want)]
    # Copies of the whole texts, with other line breaks and without the title; below each a file of its own.
    files += [(f"{k}/COPYING", "Some Project, 2020 Some Body\n" + " ".join(t.split()[12:])) for k, t in named]
    files += [(f"{k}/a/x.txt", prose(3)) for k, t in named]
    files += [("own/LICENSE", prose(12)), ("own/NOTICE", None), ("own/x.txt", prose(13))]
    df = spark.createDataFrame([(n, p, t) for n, (p, t) in enumerate(files)], "n long, path string, text string")
    got = [(r.license, r.origin) for r in licenses.scan(df, ["n"]).orderBy("n").collect()]
    k = len(want)
    assert got[:k] == [(name, "header" if name else "none") for name, _ in want]
    assert got[k : k + len(named)] == [(name, "header") for name, _ in named]
    assert got[k + len(named) : -3] == [(name, "inherited") for name, _ in named]
    assert got[-3:] == [(None, "none")] * 3


# --- sentence spans ----------------------------------------------------------
def brute_spans(texts, least=2, words=0, long_words=40):
    cuts, seen = {}, {}
    for doc, text in texts:
        cut = [" ".join(text[a:b].split()) for a, b in sentence_spans.sentences(text)] if text else []
        cuts[doc, text] = cut
        sizes, runs = [len(s.split()) for s in cut], set()
        for i in range(len(cut)):
            runs |= set([(i, j) for j in range(i + least, len(cut) + 1) if sum(sizes[i:j]) >= words][:1])
            runs |= set([(j, i + 1) for j in range(i + 1 - least, -1, -1) if sum(sizes[j : i + 1]) >= words][:1])
            if sizes[i] >= long_words:
                runs.add((i, i + 1))
        for a, b in runs:
            seen.setdefault(tuple(cut[a:b]), set()).add(((doc is None, doc or 0), text, a, b))
    return cuts, seen


def test_sentences():
    assert [("a. b!\n\n c"[a:b]) for a, b in sentence_spans.sentences("a. b!\n\n c")] == ["a. ", "b!\n\n", " c"]
    assert sentence_spans.sentences("") == [] and sentence_spans.sentences("\n \n") == []


SHORT = [
    (30, "One two. Three four. " + prose(30)), (31, "Else. One two. Three four. Last one."), (32, "Three four. Last one!"),
    (33, "Last one."), (34, "Three four. Last one. One two. Three four."), (35, prose(31, 1) + " " + "long " * 45 + "end. Tail."),
    (36, "Head. " + "long " * 45 + "end. Other tail."), (36, "One two. Three four."), (None, "Else. One two. Three four. Last one."),
]


def removed_by_brute_force(texts, words):
    cuts, seen = brute_spans(texts, words=words)
    gone = {k: set() for k in cuts}
    for places in seen.values():
        # By id; the texts of one id differ, so ties are within it.
        for (missing, doc), text, a, b in places - {min(places, key=lambda p: (p[0], xxhash64_of(p[0], p[1]), p[2]))}:
            gone[None if missing else doc, text] |= set(range(a, b))
    return cuts, gone


def xxhash64_of(place, text):
    """Spark's hash of an id and a text, which orders texts with the same id."""
    missing, doc = place
    seed = 42 if missing else xxhash.xxh64_intdigest(doc.to_bytes(8, "little", signed=True), 42)
    own = xxhash.xxh64_intdigest(text.encode(), seed)
    return own - (1 << 64 if own >> 63 else 0)


@pytest.mark.parametrize(("words", "cuts_per_part"), [(0, 4), (20, 4), (0, 1000)])
def test_sentence_spans(spark, monkeypatch, words, cuts_per_part):
    monkeypatch.setattr(sentence_spans, "CUTS", cuts_per_part)
    texts = TEXTS + SHORT
    docs = spark.createDataFrame([(i, t, *["x"] * 6) for i, t in texts], CLASHING).repartition(3)
    found = sentence_spans.remove_repeats(docs.withColumn("was", F.col("text")), words=words)
    got = {(r.doc_id, r.was): r["__kept"] for r in found.select("doc_id", "was", "__kept").collect()}
    cuts, gone = removed_by_brute_force(texts, words)
    for (doc, text), own in gone.items():
        kept = got[doc, text]
        assert kept.n_removed == len(own) and kept.n_sentences == len(cuts[doc, text])
        spans = sentence_spans.sentences(text or "")
        assert kept.text == (text if not own else "".join(text[a:b] for i, (a, b) in enumerate(spans) if i not in own))
    # The texts tell the rules apart.
    assert gone != removed_by_brute_force(texts, 20 - words)[1]
    # The passage stays in the first document that has it and goes from the other.
    assert PASSAGE in got[2, TEXTS[1][1]].text and not set(got[3, TEXTS[2][1]].text.split(". ")) & set(PASSAGE.split(". ")[1:-1])


def test_frequent_runs_are_dealt_out(spark):
    """A run held by a third of the texts is in no task with more than a few partitions' share."""
    texts = [(i, f"Own {i}. Start {i}." if i % 3 else f"Shared one. Shared two. Own {i}. Start {i}. Own {i - 1}.") for i in range(900)]
    texts = spark.createDataFrame(texts, "doc_id long, text string").withColumn("row", F.xxhash64("doc_id", "text"))
    all_runs = texts.mapInArrow(sentence_spans._spread(2, 0, 40), sentence_spans.RUNS)
    key, place = ["hash", "check"], F.struct("doc_id", "row", "pos")
    firsts = all_runs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1")
    joined = sentence_spans._join_spread(all_runs, firsts, key)
    assert joined.groupBy(*key).count().agg(F.max("count")).first()[0] == 300
    assert joined.groupBy(*key, "piece").count().agg(F.max("count")).first()[0] < 60


def test_short_sentences_are_runs_too(spark):
    texts = [(1, "One two. Three four. Alone here."), (2, "Else. One two. Three four."), (3, "One two. Other end.\nAlone here.")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.text, r["__kept"].n_removed) for r in sentence_spans.remove_repeats(df).collect()}
    assert got == {1: (texts[0][1], 0), 2: ("Else. ", 2), 3: (texts[2][1], 0)}
    assert [r[:2] for r in sentence_spans.runs(prose(5, 9))] == [(i, 2) for i in range(8)]


def test_no_sentence_spans(none):
    assert rows(sentence_spans.remove_repeats(none)) == []


# --- packing -----------------------------------------------------------------
def test_differencing_textbook():
    chosen = packing.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(np.bincount(chosen, [8, 7, 6, 5, 4])) == [14, 16]


@pytest.mark.parametrize("seed", range(5))
def test_windows_hold_the_capacity(seed):
    pick = random.Random(seed)
    sizes = [pick.randint(1, 256) for _ in range(pick.randint(1, 600))]
    chosen = packing.windows_of(sizes, 1024)
    loads = np.bincount(chosen, sizes)
    assert loads.max() <= 1024 and len(chosen) == len(sizes)
    if sum(sizes) > 20_000:
        assert loads.sum() / (1024 * len(loads)) > 0.9


def test_packing(docs, none):
    coder = Tokens(BPE)
    pieces = packing.pack(docs, BPE, capacity=64, piece=16, group=8).collect()
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in own])
        assert [p.offset for p in own] == [0, *ends[:-1].tolist()] and ends[-1] <= 64
        full = int(ends[-1])
        assert {p.padding for p in own} == {0 if full & (full - 1) == 0 else 64 - full}
    want = Counter()
    for i, text in TEXTS:
        ids = np.array([*coder.whole(text or ""), 0], "<u4")
        own = [p for p in pieces if p.doc_id == i and p.doc_tokens == len(ids)]
        for p in own:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) or i is None or i == 7
        want[i] += len(ids)
    assert Counter({i: sum(p.length for p in pieces if p.doc_id == i) for i, _ in TEXTS}) == want
    assert rows(packing.pack(none, BPE)) == []


# --- LM scores ---------------------------------------------------------------
def brute_scores(texts, order=3, alpha=0.4):
    own, corpus = [], Counter()
    for _, text in texts:
        words = WORD.findall(lowered(text))
        own.append((words, Counter(tuple(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1))))
        corpus.update(own[-1][1])
    total, out = sum(len(w) for w, _ in own), []
    for (doc, _), (words, mine) in zip(texts, own):
        score = 0.0
        for i in range(len(words)):
            back = 1.0
            for k in range(order, 0, -1):
                gram = tuple(words[max(0, i - k + 1) : i + 1])
                rest = corpus[gram] - mine[gram]
                if k == 1:
                    score += np.log(back * max(rest, 0.5) / max(total - len(words), 1))
                elif len(gram) == k and rest > 0:
                    score += np.log(back * rest / (corpus[gram[:-1]] - mine[gram[:-1]]))
                    break
                else:
                    back *= alpha
        out.append((doc, len(words), score))
    return sorted(out, key=str)


@pytest.mark.parametrize("order, per_range", [(3, 2_000_000), (2, 500), (1, 2_000_000)])
def test_backoff(docs, none, monkeypatch, order, per_range):
    monkeypatch.setattr(backoff, "RANGE_NGRAMS", per_range)
    got = rows(backoff.score(docs, order).select("doc_id", "n_words", "log_score"))
    want = brute_scores(TEXTS, order)
    assert sorted(r[:2] for r in map(tuple, got) if r[0] is not None) == sorted(r[:2] for r in want if r[0] is not None)
    assert np.allclose(sorted(r[2] for r in got), sorted(r[2] for r in want))
    assert rows(backoff.score(none)) == []


def test_pivots_of_a_batch_are_found_some_rows_at_a_time():
    """Memory is bounded however many rows and pivots meet; the pivots found stay the nearest ones."""
    import tracemalloc

    pick = np.random.default_rng(3)
    known, own = pivots._unit(pick.normal(size=(4096, 16))), pick.normal(size=(3000, 16))
    batch = pa.array(list(own), pa.list_(pa.float64()))
    tracemalloc.start()
    found = next(pivots._describe({16: known})(iter([batch]))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All similarities alone are 98 MB.
    assert peak < 60e6
    for i in range(0, 3000, 500):
        assert set(found[i]) == set(np.argsort(-(known @ own[i]))[:pivots.NEAREST].tolist())
