import ast

import pytest
from pyspark.sql import functions as F

from siftline.functions.code import AST_FEATURES, feature_counts, function_slices, register_sql
from siftline.operators.features import split_functions, with_ast_features

LOOP = "for i in x:\n  if i not in y and -i > 0:\n    t += f(i)"
CASES = [
    ("def add(a, b): return a - b", {"op_Sub": 1, "return_count": 1, "total_vars": 2, "unique_vars": 2, "var_repeat_ratio": 1.0}),
    (
        LOOP,
        {
            "cmp_NotIn": 1, "cmp_Gt": 1, "bool_And": 1, "unary_USub": 1, "aug_assign_count": 1, "total_vars": 8,
            "unique_vars": 5, "var_repeat_ratio": 1.6, "call_count": 1, "if_count": 1, "loop_count": 1,
        },
    ),
    ("def (", {}),
    ("", {}),
    (None, {}),
    ("x = '\0'", {}),
    ("async def f():\n  async for i in x: pass\n  return 1 if i else 2", {"total_vars": 3, "unique_vars": 2, "var_repeat_ratio": 1.5, "return_count": 1}),
    ("a = ~b + +c", {"op_Add": 1, "total_vars": 3, "unique_vars": 3, "var_repeat_ratio": 1.0}),
]

SAMPLE = '''
class A:
    @wrap(1)
    def m(self, é="ü"):
        def inner(x):
            return x
        return inner(é)

    class B:
        def deep(self): return 1


async def z():
    def in_z(): pass


def top(a, b):
    if a:
        def in_if(): return b
    elif b:
        try:
            def in_try(): pass
        except E:
            def in_except(): pass
        else:
            def in_else(): pass
        finally:
            def in_finally(): pass
    match a:
        case 1:
            def in_case(): pass
    for i in a:
        while i:
            with i:
                def in_loops(): pass
    return lambda: a; x = 1
'''


@pytest.mark.parametrize(("code", "expected"), CASES)
def test_features_by_hand(code, expected):
    assert {name: value for name, value in feature_counts(code).items() if value and name in AST_FEATURES} == expected


def test_feature_columns(spark):
    rows = [(number, code) for number, (code, _) in enumerate(CASES)]
    got = with_ast_features(spark.createDataFrame(rows, "id int, code string"), "code").collect()
    for row in got:
        assert tuple(row["ast"].asDict()) == AST_FEATURES
        assert {k: v for k, v in row["ast"].asDict().items() if v} == CASES[row["id"]][1]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_functions_match_the_parser(end):
    source = SAMPLE.replace("\n", end)
    nodes = [node for node in ast.walk(ast.parse(source)) if type(node) is ast.FunctionDef]
    wanted = [(node.name, ast.get_source_segment(SAMPLE, node)) for node in nodes]
    got = [(row["function_name"], row["function_code"].replace(end, "\n")) for row in function_slices(source)]
    assert got == wanted
    assert [row["ordinal"] for row in function_slices(source)] == list(range(len(nodes)))


def test_order_and_fallback(spark):
    code = "class A:\n  @d\n  def m(self):\n    def inner(): pass\nasync def z(): pass\ndef top(): pass\n"
    rows = [(1, code), (2, "def ("), (3, "x = 1"), (4, "")]
    got = split_functions(spark.createDataFrame(rows, "id int, code string")).orderBy("id", "ordinal").collect()
    assert [(r["id"], r["function_name"]) for r in got] == [
        (1, "top"), (1, "m"), (1, "inner"), (2, "UserSnippet"), (3, "UserSnippet"), (4, "UserSnippet"),
    ]
    assert got[1]["function_code"] == "def m(self):\n    def inner(): pass"
    assert got[3]["function_code"] == "def ("


def test_many_functions_in_one_file():
    tops = "\n".join(f"def t{n}(a):\n    return a + {n}\n" for n in range(20))
    methods = "class C:\n" + "\n".join(f"    def m{n}(self):\n        return {n}\n" for n in range(11))
    names = [row["function_name"] for row in function_slices(methods + tops)]
    assert names == [f"t{n}" for n in range(20)] + [f"m{n}" for n in range(11)]


def test_sql_functions(spark):
    register_sql(spark)
    spark.createDataFrame([(1, "def f(a):\n  return a + 1")], "id int, code string").createOrReplaceTempView("files")
    row = spark.sql("SELECT id, function_name FROM files, LATERAL code_functions(code)").first()
    assert row[:] == (1, "f")
    assert spark.sql("SELECT code_features(code).op_Add AS n FROM files").select(F.col("n")).first()[0] == 1.0


def test_one_parse_gives_the_features_of_each_slice(spark):
    decorated = "@a(x + y)\ndef f(p=1 - 2):\n    @b(z * z)\n    def g(q):\n        return q in p\n    return -p\n"
    texts = [SAMPLE, decorated, "x = 1 + a", "def (", "", None, *(c for c, _ in CASES)]
    files = spark.createDataFrame(list(enumerate(texts)), "id int, code string")
    featured = split_functions(files, "code", with_ast=True)
    again = with_ast_features(split_functions(files, "code"), "function_code")
    got = featured.orderBy("id", "ordinal").collect()
    assert got == again.select(*featured.columns).orderBy("id", "ordinal").collect() and len(got) > 15
    by_name = {r["function_name"]: r["ast"] for r in got if r["id"] == 1}
    assert (by_name["f"]["op_Add"], by_name["f"]["op_Mult"], by_name["g"]["op_Mult"], by_name["f"]["unary_USub"]) == (0, 1, 0, 1)


def test_parsing_leaves_nothing_in_the_process(monkeypatch):
    """The parser keeps every identifier for good, so the process that holds a task must not parse."""
    import os

    import pyarrow as pa

    from siftline.functions import code as C

    monkeypatch.setattr(C, "PARSED_TEXTS", 3)
    here = os.getpid()

    def pids(codes):
        return pa.array([os.getpid()] * len(codes), pa.int64())

    texts = pa.array([f"def f{n}(): pass" for n in range(8)] + [None])
    parts = list(C.parsed_apart(pids, iter([texts, texts.slice(0, 0)])))
    assert [len(p) for p in parts] == [3, 3, 3]
    found = {pid for part in parts for pid in part.to_pylist()}
    assert here not in found and len(found) == 3
    monkeypatch.setattr(C, "PARSED_BYTES", 16)
    assert [len(p) for p in C.parsed_apart(pids, iter([texts]))] == [1] * 7 + [2]
    with pytest.raises(RuntimeError, match="ZeroDivisionError"):
        list(C.parsed_apart(lambda codes: 1 / 0, iter([texts])))
    with pytest.raises(RuntimeError, match="ended with code 7"):
        list(C.parsed_apart(lambda codes: os._exit(7), iter([texts])))


def test_udfs_parse_in_children(spark):
    files = spark.createDataFrame([(n, f"def f{n}(a):\n    return a + {n}") for n in range(5)], "id int, code string")
    register_sql(spark)
    plan = spark.sql("SELECT id, function_name FROM {f}, LATERAL code_functions(code)", f=files)
    assert "ArrowEvalPython" in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, plan.collect())) == [(n, f"f{n}") for n in range(5)]
