"""The manifest next to trees built in memory."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from punctual.llm import merkle

CLASHING = (
    "doc_id long, text string, lang string, source string, n_chars long, place string, tree string, digest string, "
    "proof string, block string, leaf string, other string, size string, all string, root string"
)


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def lowered(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(digests, fanout):
    """The root, and for each digest its runs from below: own place and all digests."""
    paths, owners = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        new, new_owners = [], []
        for at in range(0, len(digests), fanout):
            run = digests[at : at + fanout]
            for own in range(len(run)):
                for i in owners[at + own]:
                    paths[i].append((own, run))
            new.append(h(*run))
            new_owners.append([i for o in owners[at : at + fanout] for i in o])
        digests, owners = new, new_owners
    return digests[0], paths


def brute(rows, fanout):
    sources = defaultdict(list)
    for doc, text, lang, source, n in rows:
        tampered = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        own = leaf(doc, source, lang, n, text)
        sources[source].append((doc is not None, doc or 0, own, leaf(doc, source, lang, n, lowered(text)) if tampered else own, doc))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([r[2] for r in sorted(sources[s])], fanout) for s in names}
    root, tops = tree([trees[s][0] for s in names], fanout)
    for s, top in zip(names, tops):
        for (_, _, own, other, doc), path in zip(sorted(sources[s]), trees[s][1]):
            runs = path + top
            folded = other
            for place, run in runs:
                folded = h(*run[:place], folded, *run[place + 1 :])
            siblings = h(*[d for place, run in runs for d in run[:place] + run[place + 1 :]])
            yield doc, own, trees[s][0], root, siblings, folded, folded == root


def rows_of(n):
    # "b" is hot, ids repeat, and ids, sources, texts and numbers are missing.
    out = []
    for i in range(n):
        source = [None, "b", "B", "é", "", "b", "b", "b"][i % 8] if i % 11 else f"s{i}"
        doc = None if i % 37 == 5 else i // 2 if i % 5 else i
        out.append((doc, [f"Text {i}", None, "", "ÉÀ ABC"][i % 4], [None, "fr"][i % 2], source, None if i % 9 == 0 else i))
    return out + out[:3]


@pytest.mark.parametrize(("n", "fanout", "depth"), [(1, 16, 3), (2, 16, 3), (60, 2, 1), (300, 3, 2), (400, 2, 3), (700, 16, 1), (700, 16, 3)])
def test_manifest(spark, n, fanout, depth):
    rows = rows_of(n) if n > 2 else [(4, "Only", "en", None, 4), (4, "Only", "en", "x", 4)][:n]
    docs = spark.createDataFrame([(*r, *["x"] * 10) for r in rows], CLASHING).repartition(4)
    got = [tuple(r) for r in merkle.manifest(docs, fanout=fanout, depth=depth).collect()]
    assert Counter(got) == Counter(brute(rows, fanout))
    assert n <= 2 or len({r[-1] for r in got}) == 2


def test_no_manifest(spark):
    assert merkle.manifest(spark.createDataFrame([], CLASHING)).collect() == []


def test_queue_gives_children_before_parents():
    digests = [h(str(i)) for i in range(37)]
    root, paths = tree(digests, 4)
    table = merkle.climb(digests, 3, 4)
    assert [len(t) for t in table] == [37, 10, 3, 1] and table[-1] == [root]
    for place, proof in merkle.descend(table, b"", 4):
        assert list(merkle.steps(proof)) == paths[place]
