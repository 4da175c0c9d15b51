"""Id files, fill-in-middle forms and centroids against plain versions of the same."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftline.llm import hilbert_centroids, id_files, scatter_fim
from siftline.llm.queries import QUERIES, tokenizer_path
from tests.llm.test_operators import SF, docs, odd_rows

# ---- 11: id files --------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def plain_files(library, rows):
    """``(doc_id, start, n_tokens, crc)`` by the library text by text, null ids first."""
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_query_against_the_library(spark, library):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op11_id_files"](spark, SF).orderBy("doc_id").collect()]
    assert got == plain_files(library, rows)


def test_words_give_the_ids_of_whole_texts(library):
    rng = random.Random(4)
    bits = ["a", "É", "é", "́", "Σ", "ΑΣ", "<|endoftext|>", "<|startoftext|>x", "'s", "’ll", "12", "½", "日本", " ", " ", "　",
            "\x1c", "\x85", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r\n", "İ", "ǅ", "😀", "​", "\x00", "don't", "ﬁ", "K", "<|endof", "text|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(4000)] + [None]
    encoder = id_files.WordIds(tokenizer_path("word_bpe_49k.json"))
    got = [np.frombuffer(b, encoder.kind).tolist() for b in encoder(texts)]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    id_files.KEPT_PIECES, kept = 3, id_files.KEPT_PIECES
    assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder(texts[:50])] == got[:50]
    id_files.KEPT_PIECES = kept


def test_long_texts_are_encoded_part_by_part(library, monkeypatch):
    rng = random.Random(6)
    bits = ["stone ", "water\n", "it's ", "é", "日本 ", "<|endoftext|>", " ", "'", "12", "abc", "\u0301"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(500)]
    monkeypatch.setattr(id_files, "BLOCK_BYTES", 40)
    monkeypatch.setattr(id_files, "LAID_PIECES", 3)
    assert all("".join(id_files.parts_of(t, 40)) == t for t in texts)
    encoder, most = id_files.WordIds(tokenizer_path("word_bpe_49k.json")), []
    cut = id_files.latin_pieces
    monkeypatch.setattr(id_files, "latin_pieces", lambda own: cut(own) if len(own) > 1 else most.extend(map(len, own)) or cut(own))
    got = [np.frombuffer(b, encoder.kind).tolist() for b in encoder(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert most and max(most) < 100 < max(map(len, texts))


def test_a_process_forgets_long_pieces(monkeypatch):
    encoder = id_files.WordIds(tokenizer_path("word_bpe_49k.json"))
    monkeypatch.setattr(id_files, "KEPT_PIECES", 10)
    for i in range(4):
        encoder(["stone " + "".join(random.Random(i).choices("qxzj", k=3000))])
    encoder(["stone"])
    assert list(encoder.known) == ["stone"]


def test_pieces_of_latin_texts_are_those_of_the_library(library):
    rng = random.Random(8)
    letters = [chr(i) for i in range(1, 0x250)]
    bits = ["l", "LL", "'", "'s", "s", "ll", "<|", "endoftext", "|>", "é", "1", "²", "-", "×", "÷", "ŉ", " ", "\n", "i̇"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(9))) for _ in range(20_000)]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(9))) for _ in range(20_000)]
    encoder = id_files.WordIds(tokenizer_path("word_bpe_49k.json"))
    assert encoder.latin
    got = [np.frombuffer(b, encoder.kind).tolist() for b in encoder(texts)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    other = id_files.WordIds(tokenizer_path("byte_bpe_50k.json"))
    assert not other.latin  # another file's normaliser and pattern: no piece is cut here


def test_pieces_are_cut_as_the_pattern_cuts_them():
    pattern = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]|[^\t-\r a-z0-9ªµºß-öø-ſ²³¹¼-¾]+")
    rng = random.Random(11)
    bits = ["'", "'", "s", "S", "re", "l", "v", "e", "'LL", "1", "½", ".", "É", "ŉ", "×", " ", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(20_000)] + ["'", "", "'s", "it's", "''s", "\xad'd"]
    distinct, indices, pieces = id_files.latin_pieces(texts)
    assert len(set(distinct)) == len(distinct) and len(pieces) == len(texts)
    found, at = [distinct[i] for i in indices.tolist()], 0
    for text, n in zip(texts, pieces.tolist(), strict=True):
        assert found[at : at + n] == pattern.findall(text.lower())
        at += n
    assert at == len(found)
    assert [len(x) for x in id_files.latin_pieces([])] == [0, 0, 0]


def test_tasks_of_a_worker_give_a_piece_to_the_library_once(library, monkeypatch):
    path, given = tokenizer_path("word_bpe_49k.json"), []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given.extend(w for t in texts for w in t.split())
            return library.encode_batch_fast(texts, **options)

    id_files._encoder.cache_clear()
    monkeypatch.setattr(id_files.encoder_of(path), "library", Counted())
    for _ in range(3):  # tasks
        encoder = id_files.encoder_of(path)
        assert encoder(["Stone, stone water", "stone 石 a"]) == encoder(["Stone, stone water", "stone 石 a"])
    assert sorted(given) == sorted(["stone", ",", "water", "石", "a"])
    monkeypatch.setattr(id_files, "KEPT_PIECES", 8)
    encoder([f"river{i} stone" for i in range(9)])
    del given[:]
    got = encoder(["stone river1 water"])  # only the four pieces of most calls are held on
    assert "stone" not in given and len(encoder.known) < 8
    assert np.frombuffer(got[0], encoder.kind).tolist() == library.encode("stone river1 water", add_special_tokens=False).ids
    id_files._encoder.cache_clear()


def test_odd_rows_are_kept_in_order(spark, library):
    rows = [r[:2] for r in odd_rows()] + [(None, "the stone"), (None, None), (-5, "x <|endoftext|> y")]
    path = tokenizer_path("word_bpe_49k.json")
    got = id_files.read_ids(spark, id_files.write_ids(docs(spark, rows), path), as_bytes=True)
    found = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], zlib.crc32(r["ids"])) for r in got.collect())
    want = plain_files(library, rows)
    assert found == sorted((d is not None, d or 0, n, crc) for d, _, n, crc in want)
    spans = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in got.collect())
    assert all(a + n == b for (a, n, _), (b, _, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    ids = [d for *_, d in spans]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    empty = id_files.write_ids(docs(spark, []), path)
    assert id_files.read_ids(spark, empty).count() == 0


def test_null_ids_of_a_third_of_the_rows_spread_over_files(spark):
    rows = [(None, f"stone {i}") for i in range(3000)] + [(None, "the same") for _ in range(3000)] + [(i, "water") for i in range(3000)]
    folder = id_files.write_ids(docs(spark, rows), tokenizer_path("word_bpe_49k.json"))
    files = id_files.manifest_of(spark, folder).collect()
    assert len(files) >= 6 and max(f["documents"] for f in files) < 3000


def test_single_documents_and_damage(spark, library):
    rows = [(i, f"river {i} stone " * (i % 7)) for i in range(400)] + [(7, "again")]
    folder = id_files.write_ids(docs(spark, rows), tokenizer_path("word_bpe_49k.json"))
    store, place = fs.FileSystem.from_uri(folder)
    found = {}
    names = [r["file"] for r in id_files.manifest_of(spark, folder).orderBy("part").collect()]
    for name in names:
        file = id_files.IdFile(folder, name)
        for doc in (7, 13, 399, 4000):
            found.setdefault(doc, []).extend(a.tolist() for a in file.find(doc))
        file.close()
    ids = lambda text: [*library.encode(text, add_special_tokens=False).ids, 1]
    assert sorted(found[7]) == sorted([ids(""), ids("again")]) and found[13] == [ids(rows[13][1])] and found[399] == [ids("")] and found[4000] == []
    with store.open_input_file(f"{place}/{names[0]}") as file:
        content = bytearray(file.read())
    content[-40] ^= 1  # within the index
    for broken in (content, content[: len(content) // 2]):
        with store.open_output_stream(f"{place}/broken.ids") as file:
            file.write(bytes(broken))
        with pytest.raises(ValueError):
            id_files.IdFile(folder, "broken.ids")


def test_files_no_manifest_names_are_not_read(spark):
    folder = id_files.write_ids(docs(spark, [(1, "stone"), (2, "water")]), tokenizer_path("word_bpe_49k.json"))
    store, place = fs.FileSystem.from_uri(folder)
    with store.open_output_stream(f"{place}/part-of-a-lost-task.ids") as file:
        file.write(b"SLID")
    assert id_files.read_ids(spark, folder).count() == 2


def test_dictionary_is_shared_and_helps_short_documents(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("aeioustrn", k=6)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=12))) for i in range(4000)]
    folder = id_files.write_ids(docs(spark, rows), tokenizer_path("word_bpe_49k.json"))
    store, place = fs.FileSystem.from_uri(folder)
    names = [f.base_name for f in store.get_file_info(fs.FileSelector(place)) if f.base_name.endswith(".zdict")]
    assert len(names) == 1
    with store.open_input_file(f"{place}/{names[0]}") as file:
        assert names[0] == f"dictionary-{hashlib.sha256(file.read()).hexdigest()}.zdict"
    import zstandard

    alone = sum(len(zstandard.compress(r["ids"], 3)) for r in id_files.id_arrays(docs(spark, rows), tokenizer_path("word_bpe_49k.json"), 1).collect())
    shared = sum(r["bytes"] - r["documents"] * id_files.INDEX.itemsize for r in id_files.manifest_of(spark, folder).collect())
    assert shared < 0.8 * alone


# ---- 12: fill-in-middle ---------------------------------------------------------

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_form(doc, text, rate=50, spm=80):
    digest = hashlib.sha256(f"42:{'null' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    u = TOKENS.findall(text)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc, len(u), "plain", None, None, text, text)
    form = "spm" if h[3] % 100 < spm else "psm"
    return (doc, len(u), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text)


@pytest.mark.parametrize(("group", "step"), [(1 << 22, 1 << 20), (300, 7), (1, 1 << 20)])
def test_scatter_and_gather_without_spark(monkeypatch, group, step):
    monkeypatch.setattr(scatter_fim, "GROUP_BYTES", group)
    monkeypatch.setattr(scatter_fim, "STEP", step)
    rng = random.Random(5)
    bits = [" ", "\n", "\x0b", "a", "bé", "日本", "<", "P", ">", "<P", "\t ", " ", "word", "😀", "<S", "M>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(800)] + ["", "   ", "<P>", "a<S>", None]
    draws = np.array([[rng.randrange(2**32) for _ in range(4)] for _ in texts])
    seen = set()
    for low, high, data, offsets in scatter_fim._groups(pa.array([None, *texts]).slice(1)):
        out, ends, form, n, prefix, middle = scatter_fim.scatter(data, offsets, draws[low:high], 50, 80)
        back, back_ends = scatter_fim.gather(out, ends, form)
        assert back.tobytes() == data.tobytes() and (back_ends == offsets).all()
        for i in range(low, high):
            text, h, j = texts[i] or "", draws[i].tolist(), i - low
            u = TOKENS.findall(text)
            a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
            p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
            plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50
            want = text if plain else f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 80 else f"<P>{p}<S>{s}<M>{m}"
            assert out[ends[j] : ends[j + 1]].tobytes().decode() == want and n[j] == len(u)
            assert plain or (prefix[j], middle[j]) == (len(p), len(m))
            seen.add(scatter_fim.FORMS[form[j]])
    assert seen == {"plain", "psm", "spm"}


def test_forms_of_odd_rows(spark):
    rows = [r[:2] for r in odd_rows()] + [(100 + i, f" a<P b>é\n{i} 日本 end " * (i % 5)) for i in range(60)] + [(300, "has <M> inside"), (None, "x y"), (None, "x y")]
    got = scatter_fim.restore(scatter_fim.fill_in_middle(docs(spark, rows)).withColumn("text", F.lit("clash")))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "text", "restored"]
    assert sorted(map(repr, (tuple(r) for r in got.drop("text").collect()))) == sorted(repr(plain_form(d, t or "")) for d, t in rows)
    assert scatter_fim.fill_in_middle(docs(spark, [])).count() == 0


def test_rates_are_parameters(spark):
    rows = [(i, "one two three four") for i in range(50)]
    moved = lambda **k: {r["form"] for r in scatter_fim.fill_in_middle(docs(spark, rows), **k).collect()}
    assert moved(rate=0) == {"plain"} and moved(rate=100, spm=0) == {"psm"} and moved(rate=100, spm=100) == {"spm"}


@pytest.mark.parametrize(("form", "text"), [("psm", "<P>a<M>b<S>c"), ("spm", "<S>a<P>b"), ("psm", "none"), ("psm", "x<P>a<S>b<M>c")])
def test_a_form_without_its_sentinels_is_an_error(form, text):
    data = np.frombuffer(text.encode(), np.uint8)
    with pytest.raises(ValueError):
        scatter_fim.gather(data, np.array([0, len(data)]), np.array([scatter_fim.FORMS.tolist().index(form)]))


# ---- 13: centroids --------------------------------------------------------------


def vectors(spark, rows):
    table = pa.table(
        {
            "vec_id": pa.array([r[0] for r in rows], pa.int64()),
            "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64())),
            "cluster": pa.array(["x"] * len(rows), pa.string()),
            "key": pa.array([None] * len(rows), pa.int32()),
        }
    )
    return spark.createDataFrame(table)


def plain_clusters(rows, n=8, rounds=10, dimensions=64):
    fine = [(i, [int(np.floor(1024 * x)) for x in e]) for i, e in rows if e is not None and len(e) == dimensions and all(x is not None and np.isfinite(x) for x in e)]
    order = sorted(fine, key=lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1]))
    centroids = [v for _, v in order[:n]]
    apart = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda k: (apart(v, centroids[k]), k))
    for _ in range(rounds):
        own = [nearest(v) for _, v in fine]
        for k in range(len(centroids)):
            mine = [v for (_, v), c in zip(fine, own, strict=True) if c == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, nearest(v), apart(v, centroids[nearest(v)])) for i, v in fine), key=repr), centroids


@pytest.mark.parametrize("levels", [(2, 4), (3, 3), (5, 2), (4, 1)])
def test_hilbert_neighbours_touch(levels):
    n, bits = levels
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    keys = hilbert_centroids.hilbert_keys(grid, bits)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_every_nearest_centroid():
    rng = np.random.default_rng(3)
    for _ in range(200):
        centroids = rng.integers(-50, 50, (8, 6))
        v = rng.integers(-50, 50, 6) + rng.integers(-9, 9, (30, 6))
        some = hilbert_centroids.candidates(v.min(axis=0), v.max(axis=0), centroids)
        want = ((v[:, None] - centroids) ** 2).sum(axis=2)
        number, distance = hilbert_centroids.nearest(v, centroids, some)
        assert (number == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()


def test_large_components_are_compared_exactly():
    v = np.array([[hilbert_centroids.LARGEST - 1] * 64, [-hilbert_centroids.LARGEST + 1] * 64])
    number, distance = hilbert_centroids.nearest(v, v[::-1].copy(), np.arange(2))
    assert number.tolist() == [1, 0] and distance.tolist() == [0, 0]


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (8, 64))
    return [(i, (centres[i % 8] + rng.normal(0, 0.01, 64)).tolist()) for i in range(n)]


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = clustered(300) + [(1000 + i, rng.normal(0, 0.2, 64).tolist()) for i in range(150)]
    rows += [(5000, [0.5] * 64)] * 120 + [(None, [0.25] * 64), (None, [0.25] * 64), (7, None), (8, []), (9, [0.1] * 63), (10, [float("nan")] * 64), (11, [float("inf")] + [0.0] * 63), (12, [None] + [0.0] * 63)]
    assigned, centroids = hilbert_centroids.clusters(vectors(spark, rows))
    got = hilbert_centroids.with_inertia(assigned, centroids).collect()
    want, centres = plain_clusters(rows)
    assert centroids == centres
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=repr) == want
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"]) and r["inertia"] == sum(d for *_, d in want)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.5] * 64)]
    assigned, centroids = hilbert_centroids.clusters(vectors(spark, rows))
    want, centres = plain_clusters(rows)
    assert centroids == centres and sorted(((tuple(r)) for r in assigned.collect()), key=repr) == want
    assigned, centroids = hilbert_centroids.clusters(vectors(spark, []))
    assert centroids == [] and hilbert_centroids.with_inertia(assigned, centroids).count() == 0


def test_a_component_past_the_bound_is_an_error(spark):
    with pytest.raises(Exception, match="past"):
        hilbert_centroids.clusters(vectors(spark, [(1, [1e300] + [0.0] * 63)]))


def test_boxes_spare_comparisons_where_vectors_lie_together(spark):
    whole = hilbert_centroids.whole_vectors(vectors(spark, clustered(16_000)), "vec_id", "embedding", 64)
    blocks = hilbert_centroids.zone_mapped(whole)
    pairs: list = []
    hilbert_centroids.fit(blocks, hilbert_centroids.first_centroids(whole, 8), 10, pairs=pairs)
    compared, every = pairs[-1]
    assert compared < 0.6 * every
