"""Functions that need Python's own parser, run as Arrow-batched helpers.

Each is one small loop body over a batch; Spark does the scan, the partitioning
and everything around it. The module travels inside the task, so executors need
no install of this package.
"""

from __future__ import annotations

import ast
import gc
import multiprocessing
import re
import sys
import traceback
import warnings
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The feature names in their fixed order.
AST_FEATURES = (
    "op_Add", "op_Sub", "op_Mult", "op_Div", "op_Mod", "op_Pow", "op_FloorDiv",
    "op_BitAnd", "op_BitOr", "op_BitXor", "op_LShift", "op_RShift",
    "cmp_Eq", "cmp_NotEq", "cmp_Lt", "cmp_LtE", "cmp_Gt", "cmp_GtE",
    "cmp_Is", "cmp_IsNot", "cmp_In", "cmp_NotIn",
    "bool_And", "bool_Or",
    "unary_Not", "unary_USub",
    "aug_assign_count",
    "total_vars", "unique_vars", "var_repeat_ratio",
    "call_count", "return_count", "if_count", "loop_count",
)

AST_FEATURE_TYPE = T.StructType([T.StructField(name, T.DoubleType()) for name in AST_FEATURES])

FUNCTION_SLICES = T.ArrayType(
    T.StructType(
        [
            T.StructField("ordinal", T.IntegerType()),
            T.StructField("function_name", T.StringType()),
            T.StructField("function_code", T.StringType()),
        ]
    )
)

#: Texts, and bytes of them, that one child process parses.
PARSED_TEXTS, PARSED_BYTES = 4000, 4 << 20

#: Name given to text that holds no function of its own.
WHOLE_SNIPPET = "UserSnippet"

# Node kinds that carry operators, and the family their operators count under.
_SINGLE_OPERATOR = {ast.BinOp: "op_", ast.BoolOp: "bool_", ast.UnaryOp: "unary_"}
_PLAIN_COUNT = {
    ast.AugAssign: "aug_assign_count",
    ast.Call: "call_count",
    ast.Return: "return_count",
    ast.If: "if_count",
    ast.For: "loop_count",
    ast.While: "loop_count",
}
# Fields without nodes that anything is counted on: operators, contexts, names and plain values.
_NO_COUNT = {"ctx", "op", "ops", "id", "attr", "arg", "kind", "type_comment", "type_ignores", "level", "module", "conversion"}
# The fields that hold statements; a ``def`` can be nowhere else.
_BLOCKS = {"body", "handlers", "orelse", "finalbody", "cases"}


def _kinds(base: type) -> list[type]:
    own = [kind for kind in base.__subclasses__() if kind.__module__ in ("ast", "_ast") and kind is not ast.Constant]
    return [base, *(kind for below in own for kind in _kinds(below))]


# Fields to walk of each kind of node, in source order: all that may count, and those of statements.
_COUNTED_FIELDS = {kind: tuple(f for f in kind._fields if f not in _NO_COUNT) for kind in _kinds(ast.AST)}
_BLOCK_FIELDS = {
    kind: fields
    for base in (ast.mod, ast.stmt, ast.excepthandler, ast.match_case)
    for kind in _kinds(base)
    if (fields := tuple(f for f in kind._fields if f in _BLOCKS))
}


def _answer(out, work: Callable[[pa.Array], pa.Array], codes: pa.Array) -> None:
    gc.collect(0)
    gc.disable()  # trees hold no cycles, and the process ends with them
    try:
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([work(codes)], names=["result"])
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        said = sink.getvalue()
    except BaseException:
        out.send_bytes(b"!" + traceback.format_exc().encode("utf-8", "replace"))
        return
    out.send_bytes(b"=")
    out.send_bytes(said)


def _in_child(work: Callable[[pa.Array], pa.Array], codes: pa.Array) -> pa.Array:
    """``work(codes)``, done in a child process of this one."""
    fork = multiprocessing.get_context("fork")
    heard, out = fork.Pipe(duplex=False)
    child = fork.Process(target=_answer, args=(out, work, codes))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)  # the child uses none of this process's threads
        child.start()
    out.close()
    try:
        first = heard.recv_bytes()
        if first[:1] == b"!":
            raise RuntimeError(first[1:].decode())
        return pa.ipc.open_stream(pa.py_buffer(heard.recv_bytes())).read_next_batch().column(0)
    except EOFError:
        child.join()
        raise RuntimeError(f"the parsing process ended with code {child.exitcode}") from None
    finally:
        heard.close()
        child.join()
        child.close()


def parsed_apart(work: Callable[[pa.Array], pa.Array], batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``work`` on all rows, a few thousand at a time, each in a child process.

    Python's parser keeps every identifier it has met until the process ends, so a worker that parses
    by itself grows with the different names of all files it ever gets. A child takes them along.
    """
    for codes in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(codes), 0).to_numpy(zero_copy_only=False), dtype="int64")
        low = 0
        while low < len(codes):
            before = ends[low - 1] if low else 0
            high = max(low + 1, min(low + PARSED_TEXTS, int(np.searchsorted(ends, before + PARSED_BYTES, side="right"))))
            yield _in_child(work, codes.slice(low, high - low))
            low = high


def parse_or_none(code: str | None) -> ast.AST | None:
    """The syntax tree, or None for text Python cannot parse."""
    if code is None:
        return None
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(code)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None


def _children(node: ast.AST) -> list[ast.AST]:
    """Child nodes under which something may count, in source order."""
    found = []
    for field in _COUNTED_FIELDS.get(type(node), ()):
        value = getattr(node, field, None)
        if type(value) is list:
            found += [child for child in value if isinstance(child, ast.AST)]
        elif isinstance(value, ast.AST):
            found.append(value)
    return found


def _functions_by_level(tree: ast.AST) -> list[ast.FunctionDef]:
    """Every plain ``def``, outer levels first and each level in source order."""
    found, level = [], [tree]
    while level:
        found += [node for node in level if type(node) is ast.FunctionDef]
        level = [child for node in level for field in _BLOCK_FIELDS.get(type(node), ()) for child in getattr(node, field)]
    return found


def feature_counts(code: str | None) -> Counter:
    """Non-zero syntax features of one piece of code; empty when it does not parse."""
    tree = parse_or_none(code)
    return Counter() if tree is None else tree_counts([tree])


def tree_counts(roots: list[ast.AST]) -> Counter:
    """Non-zero syntax features of some trees taken together."""
    seen: Counter = Counter()
    names: Counter = Counter()
    waiting = list(roots)
    while waiting:
        node = waiting.pop()
        kind = type(node)
        if kind is ast.Name:
            names[node.id] += 1
            continue
        if kind is ast.Compare:
            seen.update("cmp_" + type(operator).__name__ for operator in node.ops)
        elif kind in _SINGLE_OPERATOR:
            seen[_SINGLE_OPERATOR[kind] + type(node.op).__name__] += 1
        elif kind in _PLAIN_COUNT:
            seen[_PLAIN_COUNT[kind]] += 1
        waiting += _children(node)
    seen["total_vars"] = names.total()
    seen["unique_vars"] = len(names)
    seen["var_repeat_ratio"] = names.total() / max(len(names), 1)
    return seen


def _feature_batch(codes: pa.Array) -> pa.Array:
    return _feature_structs([feature_counts(code) for code in codes.to_pylist()])


def _feature_structs(of_rows: list[Counter]) -> pa.Array:
    grid = np.zeros((len(of_rows), len(AST_FEATURES)))
    for row, counts in enumerate(of_rows):
        if counts:
            grid[row] = [counts.get(name, 0) for name in AST_FEATURES]
    return pa.StructArray.from_arrays(
        [pa.array(grid[:, at]) for at in range(grid.shape[1])], names=list(AST_FEATURES)
    )


def ast_features(code: Column) -> Column:
    """STRUCT of the 34 syntax features; all zero where the code does not parse."""

    @F.arrow_udf(AST_FEATURE_TYPE)
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from parsed_apart(_feature_batch, batches)

    return features(code)


def sliced_functions(code: str | None) -> list[tuple[str, str, list[ast.AST]]]:
    """(name, source slice, trees) of every plain ``def`` in breadth-first order; of the whole text without one.

    Slices are cut from the UTF-8 bytes by the parser's own byte offsets, so one
    pass over the line starts serves all functions of a file. A slice starts at its ``def``, so the trees
    are those under the function without its decorators: what parsing the slice again would give.
    """
    if code is None:
        return []
    tree = parse_or_none(code)
    found = _functions_by_level(tree) if tree else []
    if not found:
        return [(WHOLE_SNIPPET, code, [tree] if tree else [])]
    raw = code.encode("utf-8", "surrogatepass")
    starts = [0, *(end.end() for end in re.finditer(rb"\r\n|\r|\n", raw))]
    sliced = []
    for node in found:
        start, end = starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset
        inside = [child for child in _children(node) if child not in node.decorator_list]
        sliced.append((node.name, raw[start:end].decode("utf-8", "surrogatepass"), inside))
    return sliced


def function_slices(code: str | None) -> list[dict]:
    """Every plain ``def`` in breadth-first order, as name and source slice."""
    return [
        {"ordinal": ordinal, "function_name": name, "function_code": text}
        for ordinal, (name, text, _) in enumerate(sliced_functions(code))
    ]


_SLICE_FIELDS = [("ordinal", pa.int32()), ("function_name", pa.string()), ("function_code", pa.string())]


def _sliced_batch(codes: pa.Array, with_ast: bool) -> pa.Array:
    ends, rows, counts = [0], [], []
    for code in codes:
        sliced = sliced_functions(code.as_py())
        rows += [(ordinal, name, text) for ordinal, (name, text, _) in enumerate(sliced)]
        if with_ast:
            counts += [tree_counts(trees) if trees else Counter() for _, _, trees in sliced]
        ends.append(len(rows))
    columns = [pa.array([row[at] for row in rows], type=kind) for at, (_, kind) in enumerate(_SLICE_FIELDS)]
    names = [*dict(_SLICE_FIELDS)]
    if with_ast:
        columns, names = [*columns, _feature_structs(counts)], [*names, "ast"]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=names))


def _slice_batch(codes: pa.Array) -> pa.Array:
    return _sliced_batch(codes, with_ast=False)


def _featured_slice_batch(codes: pa.Array) -> pa.Array:
    return _sliced_batch(codes, with_ast=True)


def extract_functions(code: Column) -> Column:
    """ARRAY of (ordinal, function_name, function_code), for use with ``inline``."""

    @F.arrow_udf(FUNCTION_SLICES)
    def slices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from parsed_apart(_slice_batch, batches)

    return slices(code)


def extract_featured_functions(code: Column) -> Column:
    """ARRAY of (ordinal, function_name, function_code, ast), from one parse of each text."""

    @F.arrow_udf(T.ArrayType(T.StructType([*FUNCTION_SLICES.elementType.fields, T.StructField("ast", AST_FEATURE_TYPE)])))
    def featured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from parsed_apart(_featured_slice_batch, batches)

    return featured(code)


def register_sql(spark) -> None:
    """Make the code functions callable from SQL.

    ``SELECT * FROM files, LATERAL code_functions(code)`` lists functions, and
    ``code_features(code)`` gives the feature struct.
    """

    @F.arrow_udf(FUNCTION_SLICES)
    def slices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from parsed_apart(_slice_batch, batches)

    @F.arrow_udf(AST_FEATURE_TYPE)
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from parsed_apart(_feature_batch, batches)

    spark.udf.register("code_slices", slices)
    spark.udf.register("code_features", features)
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION code_functions(code STRING)
        RETURNS TABLE (ordinal INT, function_name STRING, function_code STRING)
        RETURN SELECT inline(code_slices(code))"""
    )
