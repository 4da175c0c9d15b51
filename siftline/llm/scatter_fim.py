"""Fill-in-middle forms by displacement scatter: whole batches of text bytes are moved at once, and moved back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
WIDTH = 3
FORMS = np.array(["plain", "psm", "spm"])
PLAIN, PSM, SPM = range(3)
#: Bytes of texts laid end to end in one group (one longer text is a group), and bytes whose shifts are held at a time.
GROUP_BYTES, STEP = 1 << 22, 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_MIDDLES = np.zeros(256, bool)
_MIDDLES[[PREFIX[1], SUFFIX[1], MIDDLE[1]]] = True
_SENTINELS = np.array([list(PREFIX), list(SUFFIX), list(MIDDLE)], dtype=np.uint8)


def sentinels_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text, place)`` of every sentinel that lies within one text of ``data``, in order."""
    if len(data) < WIDTH:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero((data[:-2] == PREFIX[0]) & _MIDDLES[data[1:-1]] & (data[2:] == PREFIX[2]))
    text = np.searchsorted(offsets, at, side="right") - 1
    inside = at + WIDTH <= offsets[text + 1]
    return text[inside], at[inside]


def token_cuts(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray):
    """Tokens of each text, and the bytes at which prefix and middle end, for draws taken modulo tokens + 1.

    A token begins with each text and wherever a blank follows a letter.
    """
    blank = _BLANK[data]
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    places = np.flatnonzero(begins)
    before = np.searchsorted(places, offsets)
    n = np.diff(before)
    cuts = first % (n + 1), second % (n + 1)

    def place(cut: np.ndarray) -> np.ndarray:
        inside = cut < n
        out = offsets[1:].copy()
        out[inside] = places[before[:-1][inside] + cut[inside]]
        return out

    return n, place(np.minimum(*cuts)), place(np.maximum(*cuts))


def displacements(form: np.ndarray, starts: np.ndarray, sizes: np.ndarray, out_starts: np.ndarray):
    """``(shifts, sentinel places)`` of texts with the given sizes of prefix, middle and suffix, one row per text.

    A byte at place i of its part of the text stands at i + shift of the output.
    """
    prefix, middle, suffix = sizes.T
    lead = np.where(form == PLAIN, 0, WIDTH)
    swapped = form == SPM
    # psm is prefix, suffix, middle; spm is suffix, prefix, middle; plain is the text itself
    to_prefix = lead + np.where(swapped, suffix + WIDTH, 0)
    to_suffix = lead + np.where(swapped, 0, prefix + lead) + np.where(form == PLAIN, middle, 0)
    to_middle = np.where(form == PLAIN, prefix, 3 * WIDTH + prefix + suffix)
    own = np.stack([np.zeros_like(prefix), prefix, prefix + middle], axis=1)
    shifts = np.stack([to_prefix, to_middle, to_suffix], axis=1) - own + (out_starts - starts)[:, None]
    places = np.stack([to_prefix, to_suffix, to_middle], axis=1) - WIDTH + out_starts[:, None]
    return shifts, places


def shifted(begins: np.ndarray, shifts: np.ndarray, total: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(first byte, place each byte goes to)`` for runs of STEP of ``total`` bytes.

    ``begins`` ascends. A difference array holds the change of shift at each begin; its running sum is
    every byte's shift. Runs carry the sum over, so only STEP places exist at a time.
    """
    change = np.diff(shifts, prepend=0)
    carry = 0
    for at in range(0, total, STEP):
        upto = min(at + STEP, total)
        low, high = np.searchsorted(begins, [at, upto])
        run = np.zeros(upto - at, np.int64)
        np.add.at(run, begins[low:high] - at, change[low:high])
        run[0] += carry
        run = np.cumsum(run)
        carry = int(run[-1])
        yield at, run + np.arange(at, upto)


def _spans(offsets: np.ndarray, cut: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins = np.stack([offsets[:-1], cut, end], axis=1)
    return begins, np.stack([cut, end, offsets[1:]], axis=1) - begins


def scatter(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, rate: int, spm: int):
    """Forms of texts laid end to end: ``(output bytes, output offsets, form, n, prefix_chars, middle_chars)``."""
    n, cut, end = token_cuts(data, offsets, draws[:, 0], draws[:, 1])
    form = np.where(draws[:, 3] % 100 < spm, SPM, PSM)
    form[(draws[:, 2] % 100 >= rate) | (offsets[1:] == offsets[:-1])] = PLAIN
    form[sentinels_in(data, offsets)[0]] = PLAIN
    begins, sizes = _spans(offsets, cut, end)
    out_offsets = np.r_[0, np.cumsum(np.diff(offsets) + np.where(form == PLAIN, 0, 3 * WIDTH))]
    shifts, places = displacements(form, offsets[:-1], sizes, out_offsets[:-1])
    output = np.empty(out_offsets[-1], np.uint8)
    for at, to in shifted(begins.ravel(), shifts.ravel(), len(data)):
        output[to] = data[at : at + len(to)]
    moved = form != PLAIN
    output[places[moved][:, :, None] + np.arange(WIDTH)] = _SENTINELS
    # code points begin at all bytes but continuations
    heads = np.r_[(data & 0xC0) != 0x80, False]
    chars = np.add.reduceat(heads, begins.ravel(), dtype=np.int64).reshape(-1, 3) * (sizes > 0) if len(begins) else begins
    return output, out_offsets, form, n, chars[:, 0], chars[:, 1]


def gather(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of forms laid end to end, from the forms alone: ``(text bytes, text offsets)``."""
    moved = np.flatnonzero(form != PLAIN)
    text, at = sentinels_in(data, offsets)
    mine = form[text] != PLAIN
    text, at = text[mine], at[mine]
    if len(at) != 3 * len(moved) or (text.reshape(-1, 3) != moved[:, None]).any():
        raise ValueError("a form that is not plain holds each sentinel once")
    marks = at.reshape(-1, 3)
    sizes = np.zeros((len(form), 3), np.int64)
    sizes[:, 0] = np.diff(offsets)  # of a plain text all is prefix
    one, two = marks[:, 1] - marks[:, 0] - WIDTH, marks[:, 2] - marks[:, 1] - WIDTH
    swapped = form[moved] == SPM
    sizes[moved, 0], sizes[moved, 2] = np.where(swapped, two, one), np.where(swapped, one, two)
    sizes[moved, 1] = offsets[moved + 1] - marks[:, 2] - WIDTH
    text_offsets = np.r_[0, np.cumsum(sizes.sum(axis=1))]
    shifts, places = displacements(form, text_offsets[:-1], sizes, offsets[:-1])
    letters = np.sort(places[moved], axis=1)
    if (letters != marks).any() or (data[places[moved] + 1] != _SENTINELS[:, 1]).any():
        raise ValueError("the sentinels of a form stand in another order")
    begins = text_offsets[:-1, None] + np.cumsum(sizes, axis=1) - sizes
    out = np.empty(text_offsets[-1], np.uint8)
    for at, to in shifted(begins.ravel(), shifts.ravel(), len(out)):
        out[at : at + len(to)] = data[to]
    return out, text_offsets


def _groups(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets)`` of runs of about GROUP_BYTES of a column; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    raw = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.empty(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(raw, raw[low] + GROUP_BYTES, side="right")) - 1)
        yield low, high, data[raw[low] : raw[high]], raw[low : high + 1] - raw[low]
        low = high


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def draws_of(doc_id: Column, seed: int) -> Column:
    """Four unsigned 32-bit numbers: the first groups of eight digits of sha256 of ``seed:doc_id`` (``null`` for a null id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, text: str = "text") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` of each row, in one pass without a shuffle.

    Tokens are words with the blanks before them, and blanks at the end. Prefix and
    middle end after numbers of tokens drawn from the id; ``rate`` of 100 texts are
    moved, ``spm`` of 100 of these with the suffix first. Texts that are empty or hold
    a sentinel stay plain. A batch's texts are laid end to end; a difference array over
    the cuts gives each byte its shift, and one scatter builds all outputs.

    Null texts are empty. Null ids draw as ``null``; repeated rows are kept and draw
    alike. Other columns are not looked at; an empty table stays empty. Memory is a small multiple of
    GROUP_BYTES or of the longest text.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            drawn = part.column(2).flatten().to_numpy().reshape(-1, 4)
            for low, high, data, offsets in _groups(part.column(1)):
                out, out_offsets, form, n, prefix, middle = scatter(data, offsets, drawn[low:high], rate, spm)
                plain = form == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).slice(low, high - low), pa.array(n, pa.int64()), pa.array(FORMS[form]),
                        pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), _strings(out, out_offsets),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    drawn = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"), draws_of(F.col("doc_id").cast("long"), seed).alias("draws"))
    return drawn.mapInArrow(batches, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(forms: DataFrame, name: str = "restored") -> DataFrame:
    """``forms(form, output, ...)`` with the exact text rebuilt from these two columns as ``name``.

    Sentinels found in each output give the sizes of its parts, and one gather
    brings every byte back. A moved form without its three sentinels is an error. Null outputs are empty.
    """
    columns = forms.columns
    at_form, at_output = columns.index("form"), columns.index("output")
    number = {f: i for i, f in enumerate(FORMS.tolist())}

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            form = np.array([number[f] for f in part.column(at_form).to_pylist()], dtype=np.int64)
            for low, high, data, offsets in _groups(part.column(at_output)):
                text = _strings(*gather(data, offsets, form[low:high]))
                yield pa.RecordBatch.from_arrays([*part.slice(low, high - low).columns, text], [*columns, name])

    return forms.mapInArrow(batches, forms.withColumn(name, F.lit("")).schema)
