"""The manifest, the filter audit and the token files against plain versions, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from raingrid.llm import audit, merkle, packing, simple8b
from raingrid.llm.common import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx int, n long, hash string, part string, A boolean, digest string, start long, words string, key string"


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source) with columns of names that operators use themselves."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "t", 7, 7, "h", "p", True, "d", 9, "w", "k") for r in rows], DOCS)


def some_rows(n, seed=1):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab \nXé☃") for _ in range(rng.randrange(30))) for _ in range(n)]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "a", None, "é", "lone" if k == 3 else "hot"])) for k, t in enumerate(texts)]
    return [*rows, (None, "no id\n", "en", "hot"), (None, None, None, None), (5, "again\n", "en", "hot"), (5, "again\n", "en", "hot"), (n, None, "en", "a"), (n + 1, "", "", ""), (n + 2, "x\n" * 40_000, "en", "long")]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


# --- manifest


def plain_manifest(rows):
    trees = {}
    for r in rows:
        n = None if r[1] is None else len(r[1])
        leaf = h(enc(r[0], r[3], r[2], n, r[1]))
        struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
        later = h(enc(r[0], r[3], r[2], n, r[1].replace("\n", ""))) if struck else leaf
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf, later))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            now = levels[-1]
            levels.append([h(*now[k : k + 3]) for k in range(0, len(now), 3)])
        return levels

    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {s: climb([x[2] for x in sorted(trees[s])]) for s in names}
    top = climb([grown[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, (named, doc_id, leaf, later) in enumerate(sorted(trees[s])):
            node, proof = later, ""
            for levels, at in ((grown[s], i), (top, j)):
                for level in levels[:-1]:
                    low = at // 3 * 3
                    before, after = "".join(level[low:at]), "".join(level[at + 1 : low + 3])
                    node, proof, at = h(before, node, after), proof + before + after, at // 3
            out.append((doc_id if named else None, leaf, grown[s][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return out


@pytest.mark.parametrize("n", [0, 1, 40, 300])
def test_manifest(spark, tmp_path, n):
    rows = some_rows(n, n)
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_manifest(rows), key=str)


def test_manifest_of_one_row_and_of_none(spark, tmp_path):
    documents(spark, [(2, "a\nb", "en", "s")]).write.parquet(f"{tmp_path}/one/documents.parquet")
    row = merkle.op11_merkle_manifest(spark, f"{tmp_path}/one").first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == h("")
    documents(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert merkle.op11_merkle_manifest(spark, f"{tmp_path}/none").collect() == []


def test_every_changed_row_is_found(spark):
    rows = [(k, f"text {k}", "en", f"s{k % 3}") for k in range(50)]
    manifest = merkle.documents_manifest(documents(spark, rows))
    proofs = {r["doc_id"]: r for r in manifest.proofs().withColumn("found", merkle.fold(F.col("hash"), F.col("proof"))).collect()}
    assert {r["found"] for r in proofs.values()} == {manifest.root}
    other = merkle.documents_manifest(documents(spark, [(k, t + ("!" if k == 7 else ""), a, b) for k, t, a, b in rows]))
    assert other.root != manifest.root


# --- audit


def plain_audit(rows, labels):
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    good, bad = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    parts = {}
    for doc_id, text, lang, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and text in least and doc_id > least[text],
        }
        parts.setdefault(lang or "", []).append(({f for f, x in fails.items() if x}, doc_id in good, doc_id in bad))
    out = []
    for part, docs in parts.items():
        shapley, own = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                own.append((part, "".join(order), step + 1, len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in own]
    return out


def test_audit(spark):
    rng = random.Random(4)
    vocabulary = ["aa", "b#", "Cc", "é", "dd", *(f"w{k}" for k in range(300))]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([3, 5, 300])]) for _ in range(rng.choice([0, 5, 199, 200, 320]))) for _ in range(60)]
    rows = [(k, rng.choice(texts), rng.choice(["en", "de", "", None]), "s") for k in range(150)]
    rows += [(None, texts[0], "en", "s"), (None, texts[0], "en", "s"), (7, rows[7][1], rows[7][2], "s"), (7, texts[1], "en", "s"), (500, None, None, None), (501, "", "x", None), (502, "Q\x0b\x1c r\xa0s" * 9000, "en", "s")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 150, 2)] + [(None, 1, 1), (4, 1, 1), (9999, 1, 1), (502, 1, 0)]
    got = audit.interaction_audit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_audit(rows, labels))


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interaction_audit(documents(spark, []), none).collect() == []
    got = audit.interaction_audit(documents(spark, [(1, "some words", "en", "s")]), none).collect()
    assert len(got) == 600 and {r["good_lost"] for r in got} == {0}


# --- token files


@pytest.mark.parametrize("seed", range(6))
def test_words_hold_all_ids(seed):
    rng = np.random.default_rng(seed)
    ids = np.concatenate([rng.integers(0, 1 << int(b), int(rng.integers(0, 200)), dtype=np.uint64) for b in rng.integers(1, 64, 30)] + [np.full(500, 9, np.uint64), np.full(3, (1 << 64) - 1, np.uint64), np.zeros(0, np.uint64)])
    ends = np.sort(np.concatenate((rng.integers(0, len(ids), 25), [len(ids), len(ids)])))
    words, upto, escapes = simple8b.encode(ids, ends)
    assert (simple8b.decode(words, escapes) == ids).all() and upto[-1] == len(words)
    # a document's words hold its ids alone
    counts = np.concatenate(([0], np.cumsum(simple8b.counts_of(words))))
    assert (counts[upto] == ends).all()
    assert len(escapes) == (ids >= 1 << 60).sum()


def test_words_take_as_many_ids_as_fit():
    words, _, _ = simple8b.encode(np.array([1] * 60 + [3, 0] * 15 + [40_000] * 3, np.uint64), np.array([93]))
    assert [int(w >> np.uint64(60)) for w in words] == [2, 3, 13]
    words, _, escapes = simple8b.encode(np.array([5] * 400 + [1 << 63], np.uint64), np.array([401]))
    assert [int(w >> np.uint64(60)) for w in words] == [1, 0] and escapes.tolist() == [1 << 63]
    assert len(simple8b.encode(np.zeros(0, np.uint64), np.array([0]))[0]) == 0


def plain_tokens(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.word_tokenizer())
    own = []
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own.append((doc_id is not None, doc_id or 0, zlib.crc32((text or "").encode()), zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)))
    out, start = [], 0
    for named, doc_id, _, crc, n in sorted(own):
        out.append((doc_id if named else None, start, n, crc))
        start += n
    return out


@pytest.mark.parametrize("small", [False, True])
def test_token_files(spark, monkeypatch, small):
    if small:
        for name in ("FILE_BYTES", "AT_ONCE"):
            monkeypatch.setattr(simple8b, name, 100)
    rows = some_rows(200, 9)
    manifest = simple8b.write_tokens(documents(spark, rows).repartition(5), packing.word_tokenizer(), scratch(spark, "tokens"))
    got = simple8b.read_tokens(manifest)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == plain_tokens(rows)
    files = sorted(manifest.collect(), key=lambda r: r["first_id"])
    assert len(files) > (10 if small else 0) and sum(r["documents"] for r in files) == len(rows)


def test_any_stretch_is_read_by_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(simple8b, "BLOCK_WORDS", 8)
    rng = np.random.default_rng(2)
    folder = scratch(spark, "stretch").removeprefix("file:")
    file = simple8b._File(f"{folder}/a.s8b")
    docs = [rng.integers(0, 1 << int(rng.integers(1, 63)), int(n), dtype=np.uint64) for n in rng.integers(0, 90, 40)]
    for k, ids in enumerate(docs):
        file.add([k if k % 5 else None], ids, np.array([len(ids)]))
    documents_, total, size = file.close()
    every = np.concatenate(docs)
    assert documents_ == 40 and total == len(every)
    read = simple8b.TokenFile(f"{folder}/a.s8b")
    assert read.file.size() == size and [i.tolist() for _, i in read.documents()] == [d.tolist() for d in docs]
    for _ in range(60):
        a, n = int(rng.integers(0, len(every))), int(rng.integers(0, 200))
        n = min(n, len(every) - a)
        assert (read.read_ids(a, n) == every[a : a + n]).all()


def test_token_files_of_nothing(spark):
    manifest = simple8b.write_tokens(documents(spark, []), packing.word_tokenizer(), scratch(spark, "tokens"))
    assert simple8b.read_tokens(manifest).collect() == []
