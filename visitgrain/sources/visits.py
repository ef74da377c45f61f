"""The visits table over the star schema of orders, line items, customers and parts.

``visits_view`` is the mapping itself, one lazy plan. ``visits`` is what queries read: the same
rows ingested once into a partitioned Parquet table in the shared folder, so that a dashboard of
many queries pays for the joins once and prunes partitions afterwards.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from visitgrain.schema import PARTITIONS
from visitgrain.session import finer_shuffles, shared_dir
from visitgrain.sources.fs import finished, hadoop_path
from visitgrain.sources.tables import read_stored_visits, with_partitions, write_dealt

# Part of every stored table's name; raise it when what is written changes.
LAYOUT_VERSION = "3"

STAR_TABLES = ("lineitem", "orders", "customer", "nation", "region", "part")

# One text for Spark and DuckDB: every table name is a view of the same name.
VISITS_SQL = """
SELECT
  CAST(l.l_orderkey*8 + l.l_linenumber AS BIGINT) AS id_registrasi,
  o.o_custkey AS id_pasien,
  CASE WHEN l.l_linestatus='F' THEN 'Perempuan' ELSE 'Laki-laki' END AS jenis_kelamin,
  CAST(-1 AS BIGINT) AS ttl,
  r.r_name AS provinsi,
  n.n_name AS kabupaten,
  l.l_returnflag AS rujukan,
  l.l_orderkey AS no_registrasi,
  CASE o.o_orderstatus WHEN 'O' THEN 'Rawat Jalan' WHEN 'F' THEN 'Rawat Inap' ELSE 'IGD' END
    AS jenis_registrasi,
  CASE WHEN l.l_linenumber=1 THEN 't' ELSE 'f' END AS fix_pasien_baru,
  p.p_brand AS nama_departemen,
  o.o_orderpriority AS jenis_penjamin,
  CASE WHEN p.p_size=50 THEN NULL ELSE concat(p.p_type,'-',CAST(p.p_size AS VARCHAR(10))) END
    AS diagnosa_primer,
  c.c_name AS nama_instansi_utama,
  o.o_orderdate AS waktu_registrasi,
  l.l_extendedprice*(1-l.l_discount) AS total_semua_hpp,
  l.l_extendedprice AS total_tagihan,
  CAST(o.o_orderdate AS DATE) AS tanggal_lahir,
  l.l_shipdate AS tglPulang,
  CAST(p.p_size AS DOUBLE) AS usia,
  c.c_mktsegment AS kategori_usia,
  p.p_type AS kelas_hak,
  l.l_quantity AS los_rawatan,
  p.p_name AS pekerjaan
FROM {lineitem} l
JOIN {orders} o ON l.l_orderkey=o.o_orderkey
JOIN {customer} c ON o.o_custkey=c.c_custkey
JOIN {nation} n ON c.c_nationkey=n.n_nationkey
JOIN {region} r ON n.n_regionkey=r.r_regionkey
JOIN {part} p ON l.l_partkey=p.p_partkey
"""

# The same rows for Spark, in two steps: what the joins carry, and the columns made of it. The line items meet
# their parts and the orders their customers first, so that the widest rows are shuffled once, by order,
# where rows of one order lie together and compress well.
_SELECTED = re.sub(r"\b[locnrp]\.(?=[locnrp]_)", "", VISITS_SQL.split("FROM {lineitem}")[0])
_JOINED_SQL = """
SELECT l_orderkey, l_linenumber, l_linestatus, l_returnflag, l_extendedprice, l_discount, l_quantity, l_shipdate,
  o_custkey, o_orderstatus, o_orderpriority, o_orderdate, c_name, c_mktsegment, n_name, r_name,
  p_brand, p_size, p_type, p_name
FROM (SELECT * FROM {lineitem} JOIN {part} ON l_partkey=p_partkey)
JOIN (SELECT * FROM {orders} JOIN {customer} ON o_custkey=c_custkey
  JOIN {nation} ON c_nationkey=n_nationkey JOIN {region} ON n_regionkey=r_regionkey) ON l_orderkey=o_orderkey
"""


def joined(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The base columns that visits are made of, a row for each visit."""
    return spark.sql(_JOINED_SQL, **tables)


def visits_of(joined: DataFrame, *others: str) -> DataFrame:
    """The 24 columns from the base columns, and ``others`` as they are; nothing is joined or moved."""
    return joined.sparkSession.sql(", ".join([_SELECTED.rstrip(), *others]) + " FROM {joined}", joined=joined)


def table_path(sf_dir: str, table: str) -> str:
    return f"{sf_dir.rstrip('/')}/{table}.parquet"


def _star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(table_path(sf_dir, t)) for t in STAR_TABLES}


def visits_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 columns as one lazy plan over the base tables.

    No broadcast is forced: Catalyst broadcasts a dimension whose size is under its threshold
    and otherwise joins by shuffle, where adaptive execution splits skewed keys.
    """
    return visits_of(joined(spark, _star(spark, sf_dir)))


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Changes whenever a base table's files change: location, size, file count, time."""
    root, fs = hadoop_path(spark, sf_dir)
    found = {s.getPath().getName(): s for s in fs.listStatus(root)}
    parts = [LAYOUT_VERSION, VISITS_SQL, fs.makeQualified(root).toString()]
    for table in STAR_TABLES:
        status = found[f"{table}.parquet"]
        size, count = status.getLen(), 1
        if status.isDirectory():
            summary = fs.getContentSummary(status.getPath())
            size, count = summary.getLength(), summary.getFileCount()
        parts.append(f"{table} {status.getModificationTime()} {size} {count}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:20]


def base_length(spark: SparkSession, sf_dir: str) -> int:
    """Bytes of the base tables."""
    paths = [hadoop_path(spark, table_path(sf_dir, t)) for t in STAR_TABLES]
    return sum(fs.getContentSummary(p).getLength() for p, fs in paths)


def stored_once(
    spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]
) -> str | None:
    """Path of a table derived from the base tables, written at most once per version of them.

    Each writer uses a folder of its own, so two sessions that build the same table at once
    cannot damage each other's files. None where there is no shared folder.
    """
    folder = shared_dir(spark)
    if folder is None:
        return None
    prefix = f"{folder}/visitgrain-{name}-{_fingerprint(spark, sf_dir)}"
    done = finished(spark, f"{prefix}-*")
    if done:
        return done[0]
    path = f"{prefix}-{uuid.uuid4().hex[:8]}"
    write(path)
    return path


def _store(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The visits dealt to their months as base columns, which are narrower; the others are made after."""
    with finer_shuffles(spark, base_length(spark, sf_dir)):
        dealt = with_partitions(joined(spark, _star(spark, sf_dir)), "o_orderdate").hint("rebalance", *PARTITIONS)
        write_dealt(visits_of(dealt, *PARTITIONS), path)


def visits_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visits for a single pass: the stored table if it is there, else the lazy view, not stored."""
    folder = shared_dir(spark)
    done = finished(spark, f"{folder}/visitgrain-visits-{_fingerprint(spark, sf_dir)}-*") if folder else []
    return read_stored_visits(spark, done[0]) if done else visits_view(spark, sf_dir)


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visits table, stored once per version of the base tables.

    Partition columns are included so that time filters prune. Without a shared folder the lazy
    view is returned instead, with the same columns.
    """
    path = stored_once(
        spark, sf_dir, "visits",
        lambda to: _store(spark, sf_dir, to),
    )
    if path is None:
        return with_partitions(visits_view(spark, sf_dir))
    return read_stored_visits(spark, path)
