"""Files of token ids: one zstandard frame per document, a dictionary shared by all, and an index of offsets.

Layout of a file, numbers little-endian::

    "SLID" version:u8 width:u8 dictionary sha256:32 bytes      head
    frame, frame, ...                                         one per document, in order
    index                                                     one INDEX record per document
    index offset:u64 documents:u64 index crc32:u32 "SLID"     tail

Next to the files lie ``dictionary-<sha256>.zdict`` and ``manifest``, a Parquet table with one row per file.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.session import shared_folder, written

MAGIC, VERSION = b"SLID", 1
HEAD, TAIL = struct.Struct("<4sBB32s"), struct.Struct("<QQI4s")
#: ``known`` is 0 for a null id; ``at`` is the frame's place, ``start`` the ids of all documents before it in the file.
INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("at", "<u8"), ("start", "<u8"), ("n", "<u8")])
#: Pieces of id arrays the dictionary is trained on, bytes of one, and bytes of the dictionary.
FIT_PIECES, PIECE_BYTES, DICTIONARY_BYTES = 2_000, 2_048, 64 * 1024
LEVEL = 3
#: Bytes of ids aimed at for one file, and bytes of frames read at once.
FILE_BYTES, READ_BYTES = 64 << 20, 4 << 20
#: Distinct pieces kept with their ids in a process, and most ids of one of them on average; pieces given to the library
#: together, pieces whose ids are laid out together, and bytes of text encoded together.
KEPT_PIECES, KEPT_IDS, RUN, LAID_PIECES, BLOCK_BYTES = 800_000, 8, 256, 1 << 18, 4 << 20

#: Normaliser and pattern of this family of vocabularies, as its files state them. The pattern's pieces
#: for plain Latin texts: no special token, no letter whose lower case is two, no white space beyond ASCII.
LATIN_SPEC = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
PLAIN_LATIN = re.compile("[\t-\r -~¡-įı-ſ]*")
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
#: What each lower-cased character of plain Latin texts is to the pattern.
LATIN_KINDS = np.full(ord("ſ") + 1, _SIGN, np.uint8)
for _kind, _found in ((_SPACE, "[\t-\r ]"), (_LETTER, "[a-zªµºß-öø-ſ]"), (_DIGIT, "[0-9²³¹¼-¾]")):
    LATIN_KINDS[[i for i in range(len(LATIN_KINDS)) if re.fullmatch(_found, chr(i))]] = _kind
BLANK = re.compile("[\t-\r ]")
SHORTENED = ("s", "t", "re", "ve", "m", "ll", "d")


def latin_pieces(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces of plain Latin texts, the number of each piece among them in order, and the pieces of each text.

    A piece begins where the kind of character changes, and at every digit. An apostrophe that begins a run of signs
    takes the letters of SHORTENED after it, and what follows these begins a piece.
    """
    text = "\n".join([*texts, ""]).lower()
    chars = np.frombuffer(text.encode("utf-16-le"), "<u2")
    kinds = LATIN_KINDS[chars]
    first = kinds == _DIGIT
    first[:1] |= kinds[:1] != _SPACE
    first[1:] |= (kinds[1:] != kinds[:-1]) & (kinds[1:] != _SPACE)
    quotes = np.flatnonzero((chars == ord("'")) & first)
    if len(quotes):
        for letters in SHORTENED:
            at = quotes[quotes + len(letters) < len(chars)]
            for i, letter in enumerate(letters, 1):
                at = at[chars[at + i] == ord(letter)]
            first[at + 1] = False
            after = at + len(letters) + 1
            after = after[after < len(chars)]
            first[after] |= kinds[after] != _SPACE
    held = kinds != _SPACE
    last = held.copy()
    last[:-1] &= first[1:] | ~held[1:]
    starts = np.flatnonzero(first)
    # pieces lie end to end once the white space is gone, two bytes a character
    offsets = np.r_[0, np.cumsum(np.flatnonzero(last) + 1 - starts)] * 2
    laid = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(chars[held])])
    coded = laid.dictionary_encode()
    letters = b"".join(coded.dictionary.to_pylist()).decode("utf-16-le")
    bounds = np.r_[0, np.cumsum(pc.binary_length(coded.dictionary).to_numpy() // 2)].tolist()
    distinct = [letters[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return distinct, coded.indices.to_numpy(), np.diff(np.searchsorted(starts, ends), prepend=0)


def blank_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """As ``latin_pieces``, but the words between ASCII white space of any texts."""
    words = [[w.decode() for w in t.encode().split()] for t in texts]
    place: dict[str, int] = {}
    indices = [place.setdefault(w, len(place)) for found in words for w in found]
    return list(place), np.array(indices, np.int64), np.array([len(found) for found in words], np.int64)


def parts_of(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` characters, cut after ASCII white space."""
    at = 0
    while at < len(text):
        blank = BLANK.search(text, at + size)
        end = blank.end() if blank else len(text)
        yield text[at:end]
        at = end


class WordIds:
    """The library's ids of whole texts, each distinct piece of text encoded once while it is held.

    The vocabulary drops white space and no merge, normalisation or special token crosses an ASCII
    blank, so a text's ids are those of its words between such blanks, one after another. If the file
    normalises and cuts texts as LATIN_SPEC says, texts of plain Latin letters, digits and signs are cut into
    its pieces here, and the library encodes each distinct piece; the words of other texts, or for other files, go to it whole.
    Of more than KEPT_PIECES pieces, or as many times KEPT_IDS ids, the half that most blocks used is held on.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = np.dtype(id_type(self.library.get_vocab_size()))
        spec = json.loads(self.library.to_str())
        self.latin = {k: spec[k] for k in LATIN_SPEC} == LATIN_SPEC
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for token, i in self.library.get_vocab().items() if token.endswith(suffix)]] = True
        self.latin &= bool(suffix)
        self._hold({}, np.empty(0, self.kind), np.empty(0, np.int64), np.empty(0, np.int64))

    def _hold(self, known: dict[str, int], ids: np.ndarray, sizes: np.ndarray, used: np.ndarray) -> None:
        """``known``: the number of each piece. Ids lie end to end in that order; ``used`` counts the blocks that used a piece."""
        self.known, self.ids, self.sizes, self.used = known, ids, sizes, used
        self.at = np.cumsum(sizes) - sizes

    def _learn(self, pieces: list[str], plain: bool) -> None:
        """Ids of pieces not known yet: plain ones, each a word to the library, in runs cut at the ends of words."""
        ids, sizes = [self.ids], [self.sizes]
        runs = [pieces[i : i + RUN] for i in range(0, len(pieces), RUN)] if plain else []
        for run, found in zip(runs, self.library.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids.append(np.array(found.ids, self.kind))
            cuts = np.flatnonzero(self.ends[ids[-1]]) + 1
            if len(cuts) != len(run):
                raise ValueError("the vocabulary ends words elsewhere")
            sizes.append(np.diff(cuts, prepend=0))
        if not plain:
            ids += [np.array(found.ids, self.kind) for found in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
            sizes.append(np.array([len(i) for i in ids[1:]], np.int64))
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self._hold(self.known, np.concatenate(ids), np.concatenate(sizes), np.r_[self.used, np.zeros(len(pieces), np.int64)])

    def _forget(self) -> None:
        """Hold on the half of KEPT_PIECES that most blocks used; these blocks count half from now on."""
        kept = np.argsort(-self.used, kind="stable")[: KEPT_PIECES // 2]
        kept = np.sort(kept[np.cumsum(self.sizes[kept]) <= KEPT_PIECES // 2 * KEPT_IDS])
        names = list(self.known)
        self._hold({names[i]: n for n, i in enumerate(kept.tolist())}, self._laid(kept), self.sizes[kept], self.used[kept] // 2)

    def _laid(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of pieces, given by their numbers, end to end."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.at[numbers] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def _coded(self, distinct: list[str], indices: np.ndarray, pieces: np.ndarray, plain: bool) -> list[bytes]:
        """The ids of each text as bytes; its pieces are the next of ``indices`` into ``distinct``."""
        numbers = np.fromiter(map(self.known.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            numbers[fresh] = np.arange(len(self.known), len(self.known) + len(fresh))
            self._learn([distinct[i] for i in fresh.tolist()], plain)
        self.used[numbers] += 1
        numbers = numbers[indices]
        found = b"".join(self._laid(numbers[i : i + LAID_PIECES]).tobytes() for i in range(0, len(numbers), LAID_PIECES))
        bounds = np.r_[0, np.cumsum(self.sizes[numbers])][np.r_[0, np.cumsum(pieces)]] * self.kind.itemsize
        return [found[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _block(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KEPT_PIECES or len(self.ids) > KEPT_PIECES * KEPT_IDS:
            self._forget()
        plain = [self.latin and "<|" not in t and PLAIN_LATIN.fullmatch(t) is not None for t in texts]
        latin = self._coded(*latin_pieces([t for t, p in zip(texts, plain, strict=True) if p]), True)
        others = self._coded(*blank_words([t for t, p in zip(texts, plain, strict=True) if not p]), False)
        coded = {True: iter(latin), False: iter(others)}
        return [next(coded[p]) for p in plain]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes. A text of more than BLOCK_BYTES characters is encoded part by part."""
        long = {i: t for i, t in enumerate(texts) if t and len(t) > BLOCK_BYTES}
        coded = self._block(["" if i in long else t or "" for i, t in enumerate(texts)])
        for i, text in long.items():
            coded[i] = b"".join(self._block([part])[0] for part in parts_of(text, BLOCK_BYTES))
        return coded


@functools.lru_cache(maxsize=1)
def _encoder(path: str, changed: int, size: int) -> WordIds:
    return WordIds(path)


def encoder_of(path: str) -> WordIds:
    """The encoder of this process, so the tasks of one worker build it once and share its pieces while the file stays as it is."""
    found = os.stat(path)
    return _encoder(path, found.st_mtime_ns, found.st_size)


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def id_arrays(docs: DataFrame, path: str, end: int) -> DataFrame:
    """``(doc_id, n, ids)``: ids as bytes of the vocabulary's width, ``end`` after each document's."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        last = np.array([end], encoder.kind).tobytes()

        def made(ids: list, texts: list) -> pa.RecordBatch:
            coded = [c + last for c in encoder(texts)]
            counts = pa.array([len(c) // encoder.kind.itemsize for c in coded], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), counts, pa.array(coded, pa.binary())], ["doc_id", "n", "ids"])

        for part in parts:
            ids, texts, size = [], [], 0
            for doc, text in zip(part.column(0), part.column(1), strict=True):
                ids.append(doc.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= BLOCK_BYTES:
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield made(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, "doc_id long, n long, ids binary")


def train_dictionary(arrays: DataFrame, row: str = "row", pieces: int = FIT_PIECES) -> bytes:
    """A zstandard dictionary from about ``pieces`` pieces of PIECE_BYTES of ``arrays(ids, row)``, chosen by hash.

    Every piece of every document, whatever its place in a text, is as likely to be
    taken; at most twice ``pieces`` are fetched. It serves compression only: no id depends on it. Too few
    pieces to train on are themselves the dictionary.
    """
    import zstandard

    count = F.greatest(F.ceil(F.octet_length("ids") / PIECE_BYTES), F.lit(1)).cast("int")
    total = arrays.agg(F.sum(count.cast("long"))).first()[0] or 0
    share = int(min(1.0, pieces / max(total, 1)) * (1 << 30))
    taken = F.filter(F.sequence(F.lit(0), count - 1), lambda k: F.pmod(F.xxhash64(row, k), F.lit(1 << 30)) < share)
    cut = F.transform(taken, lambda k: F.substring(F.col("ids"), k * PIECE_BYTES + 1, F.lit(PIECE_BYTES)))
    found = arrays.select(F.explode(cut).alias("piece")).limit(2 * pieces).toArrow()["piece"].to_pylist()
    samples = sorted(bytes(p) for p in found if p)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(content: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(content) if content else None


def _head(width: int, digest: bytes) -> bytes:
    return HEAD.pack(MAGIC, VERSION, width, digest)


def _tail(at: int, index: bytes) -> bytes:
    return TAIL.pack(at, len(index) // INDEX.itemsize, zlib.crc32(index), MAGIC)


def _width(head: bytes) -> tuple[int, bytes]:
    magic, version, width, digest = HEAD.unpack(head)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a file of ids")
    return width, digest


class IdFile:
    """One file of ids, read by its index: the whole of it in runs, or single documents."""

    def __init__(self, folder: str, name: str) -> None:
        import zstandard

        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.file = self.store.open_input_file(f"{self.folder}/{name}")
        size = self.file.size()
        self.width, digest = _width(self.file.read_at(HEAD.size, 0))
        at, documents, check, magic = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        # the tail is checked before anything is read by its numbers
        fits = magic == MAGIC and at + documents * INDEX.itemsize + TAIL.size == size
        index = self.file.read_at(documents * INDEX.itemsize, at) if fits else b""
        if not fits or zlib.crc32(index) != check:
            raise ValueError(f"{name} is cut or damaged")
        self.index = np.frombuffer(index, INDEX)
        self.ends = np.r_[self.index["at"][1:], np.uint64(at)].astype(np.int64) if documents else np.empty(0, np.int64)
        with self.store.open_input_file(f"{self.folder}/dictionary-{digest.hex()}.zdict") as file:
            content = file.read()
        if hashlib.sha256(content).digest() != digest:
            raise ValueError("the dictionary is not the one the file names")
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(content)).decompress

    def close(self) -> None:
        self.file.close()

    def ids_between(self, low: int, high: int) -> list[np.ndarray]:
        """Id arrays of the documents ``low`` to ``high`` - 1, from one read."""
        if low >= high:
            return []
        first = int(self.index["at"][low])
        run = self.file.read_at(int(self.ends[high - 1]) - first, first)
        places = (self.index["at"][low:high].astype(np.int64) - first).tolist()
        ends = (self.ends[low:high] - first).tolist()
        return [np.frombuffer(self.unpack(run[a:b]), f"<u{self.width}") for a, b in zip(places, ends, strict=True)]

    def runs(self) -> Iterator[tuple[int, int]]:
        """Runs of documents of about READ_BYTES of frames, and of ids once they are unpacked."""
        low = 0
        # a frame may unpack to far more than it takes, so both sizes bound a run
        work = np.maximum(np.cumsum(self.index["n"].astype(np.int64)) * self.width, self.ends)
        while low < len(self.index):
            base = int(work[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(work, base + READ_BYTES, side="right")))
            yield low, high
            low = high

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The id arrays of a document's rows: its place by binary search of the index, and only its frames read."""
        nulls = len(self.index) - int(self.index["known"].sum())
        own = self.index["doc_id"][nulls:]
        low, high = np.searchsorted(own, [doc_id, doc_id], side="left")
        high = np.searchsorted(own, doc_id, side="right")
        return self.ids_between(nulls + int(low), nulls + int(high))


def write_ids(docs: DataFrame, path: str, end: int = 1, folder: str | None = None) -> str:
    """Write the ids of every text of ``docs``, by ascending doc_id, and return the folder.

    Texts are encoded once. Rows are then range-partitioned by id, digest of the ids and row number, so rows
    of one id, or of no id, of any number spread over files; each task writes its rows, one after
    another, to a file with a name of its own. A file counts once the manifest names
    it, so a task that is run again after a lost executor leaves nothing behind that is read.
    ``path`` is the vocabulary file at the same place on every executor; the folder must be one that pyarrow
    reaches from everywhere (file, hdfs, s3, gs).

    Null texts are empty and hold the end id alone. Null ids come first; repeated rows are
    kept. Other columns are not looked at. An empty table gives a manifest without files.
    """
    import zstandard

    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/siftline/ids-{uuid.uuid4().hex}"
    arrays = written(id_arrays(docs, path, end).withColumn("row", F.monotonically_increasing_id()), "id-arrays", compression="zstd")
    content = train_dictionary(arrays)
    digest = hashlib.sha256(content).digest()
    store, place = fs.FileSystem.from_uri(folder)
    store.create_dir(place, recursive=True)
    with store.open_output_stream(f"{place}/dictionary-{digest.hex()}.zdict") as file:
        file.write(content)
    from tokenizers import Tokenizer

    width = np.dtype(id_type(Tokenizer.from_file(path).get_vocab_size())).itemsize
    size, rows = arrays.agg(F.sum(F.octet_length("ids").cast("long")), F.count(F.lit(1))).first()
    files = max(-(-(size or 0) // FILE_BYTES), min(spark.sparkContext.defaultParallelism, -(-rows // 1000)), 1)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(content))
        name, out, index, part_number = f"part-{uuid.uuid4().hex}.ids", None, [], 0
        at, start = len(_head(width, digest)), 0
        held, _ = fs.FileSystem.from_uri(folder)
        for part in parts:
            if not part.num_rows:
                continue
            if out is None:
                out = held.open_output_stream(f"{place}/{name}")
                out.write(_head(width, digest))
                part_number = part.column(3)[0].as_py()
            records = np.zeros(part.num_rows, INDEX)
            for i, (doc, n, ids) in enumerate(zip(part.column(0), part.column(1).to_pylist(), part.column(2), strict=True)):
                frame = compressor.compress(ids.as_py())
                out.write(frame)
                doc = doc.as_py()
                records[i] = (doc or 0, doc is not None, at, start, n)
                at, start = at + len(frame), start + n
            index.append(records)
        if out is None:
            return
        packed = np.concatenate(index).tobytes()
        documents = len(packed) // INDEX.itemsize
        tail = _tail(at, packed)
        out.write(packed + tail)
        out.close()
        row = [part_number, name, documents, start, at + len(packed) + len(tail)]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["part", "file", "documents", "ids", "bytes"])

    order = [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("row")]
    dealt = arrays.withColumn("digest", F.xxhash64("ids")).repartitionByRange(files, *order).sortWithinPartitions(*order)
    named = dealt.select("doc_id", "n", "ids", F.spark_partition_id().alias("part"))
    manifest = named.mapInArrow(batches, "part int, file string, documents long, ids long, bytes long")
    manifest.write.parquet(f"{folder}/manifest")
    return folder


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """The files of ``folder`` in order, with ``start``: the ids in all files before."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.schema("part int, file string, documents long, ids long, bytes long").parquet(f"{folder}/manifest")
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_ids(spark: SparkSession, folder: str, as_bytes: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document of the files, one task for each few files.

    ``ids`` is an array, or little-endian unsigned 32-bit numbers as bytes. A cut
    file, a damaged index or another dictionary than the one a file names is an error.
    """
    files = manifest_of(spark, folder).select("file", "start")
    count = files.count()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, start in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                file = IdFile(folder, name)
                for low, high in file.runs():
                    own = file.index[low:high]
                    arrays = [a.astype("<u4") for a in file.ids_between(low, high)]
                    if any(len(a) != n for a, n in zip(arrays, own["n"].tolist(), strict=True)):
                        raise ValueError(f"{name}: the index counts other ids than the frames hold")
                    ids = pa.array([a.tobytes() for a in arrays], pa.binary()) if as_bytes else pa.array([a.astype(np.int64) for a in arrays], pa.list_(pa.int64()))
                    columns = [
                        pa.array(own["doc_id"].astype(np.int64), mask=own["known"] == 0),
                        pa.array(own["start"].astype(np.int64) + start), pa.array(own["n"].astype(np.int64)), ids,
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])
                file.close()

    kind = "binary" if as_bytes else "array<long>"
    return files.repartition(max(1, count)).mapInArrow(batches, f"doc_id long, start long, n_tokens long, ids {kind}")
