"""Compare every registered query with its SQL: ``python tests/check_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from siftline.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def canonical(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    return sorted(zip(*[table.column(name).to_pylist() for name in names], strict=True), key=repr)


def compare(spark, connection, sf_dir: str, name: str) -> str | None:
    """None where rows, columns, types and values agree, else what differs."""
    got = contract.queries()[name](spark, sf_dir).toArrow()
    want = connection.execute(contract.oracle_sql()[name]).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} vs {sorted(want.column_names)}"
    if got.num_rows != want.num_rows:
        return f"rows {got.num_rows} vs {want.num_rows}"
    left, right = canonical(got), canonical(want)
    if left != right:
        pair = next((a, b) for a, b in zip(left, right, strict=True) if a != b)
        return f"values {str(pair)[:600]}"
    kinds = {c: (str(got.schema.field(c).type), str(want.schema.field(c).type)) for c in got.column_names}
    kinds = {c: pair for c, pair in kinds.items() if pair[0] != pair[1]}
    return f"types {kinds}" if kinds else None


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(contract.queries())
    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracle, failed = connect(sf_dir), contract.oracle_sql(), 0
    for name in names:
        started = time.time()
        try:
            if name in oracle:
                problem = compare(spark, connection, sf_dir, name)
            else:
                frame = contract.queries()[name](spark, sf_dir).toPandas()
                problem = None if len(frame) else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        failed += problem is not None
        kind = "oracle" if name in oracle else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] {time.time() - started:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed of {len(names)}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
