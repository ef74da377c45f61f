"""F-*, T-*, A-*, R-*, J-*, U-*, P-*: single operators over the whole visits table."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitgrain.functions import dates
from visitgrain.functions.measures import bankers_round
from visitgrain.operators.cube import cube_series
from visitgrain.operators import aggregate as agg, filters as flt, rank, reshape, resample
from visitgrain.operators.resample import PERIOD
from visitgrain.plans.common import period as bucketed
from visitgrain.registry.core import on_visits, rounded
from visitgrain.registry.dashboards import (
    AGES,
    DAYS_180,
    DEPARTMENT,
    DIAGNOSIS,
    DISTRICT,
    IN_MONTH,
    IN_YEAR,
    LATEST_MONTH,
    SIX_MONTHS,
    SIX_MONTHS_DAY,
    TYPES,
    counts,
    period,
)

TS, REVENUE, COST = "waktu_registrasi", "total_tagihan", "total_semua_hpp"
LATEST = "(SELECT max(waktu_registrasi) FROM visits)"


def _summary(df):
    """What a filter kept, by registration type."""
    return rounded(
        df.groupBy("jenis_registrasi").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("id_pasien").alias("patients"),
            F.sum(REVENUE).alias("revenue"),
        ),
        "revenue", digits=2,
    )


def _summary_sql(where: str) -> str:
    return f"""SELECT jenis_registrasi, count(*) AS n, count(DISTINCT id_pasien) AS patients,
        round(sum(total_tagihan), 2) AS revenue FROM visits WHERE {where} GROUP BY 1"""


def _filter(key, keep, where) -> None:
    on_visits(key, lambda v: _summary(keep(v)), _summary_sql(where))


def register_filters() -> None:
    _filter("F-1", lambda v: flt.in_year(v, TS, 2000), IN_YEAR)
    _filter("F-2", lambda v: flt.in_month(v, TS, 5), "month(waktu_registrasi) = 5")
    _filter("F-3", lambda v: flt.in_year(v, TS, 2000, 5), IN_MONTH)
    _filter("F-3_december", lambda v: flt.in_year(v, TS, 1999, 12),
            "year(waktu_registrasi) = 1999 AND month(waktu_registrasi) = 12")
    _filter("F-4", lambda v: flt.equals(v, kabupaten=DISTRICT), f"kabupaten = '{DISTRICT}'")
    _filter("F-5", lambda v: flt.equals(v, diagnosa_primer=DIAGNOSIS, nama_departemen=None),
            f"diagnosa_primer = '{DIAGNOSIS}'")
    _filter("F-5_clinic", lambda v: flt.equals(v, nama_departemen=DEPARTMENT, jenis_registrasi="IGD"),
            f"nama_departemen = '{DEPARTMENT}' AND jenis_registrasi = 'IGD'")
    _filter("F-6", lambda v: flt.base_filter(v, year=2000, month=5, district=DISTRICT, reg_type="IGD"),
            f"{IN_MONTH} AND kabupaten = '{DISTRICT}' AND jenis_registrasi = 'IGD'")
    _filter("F-6_month_alone", lambda v: flt.base_filter(v, month=5), "true")
    for tag, name, span in (("_day", "day", "1 day"), ("_week", "week", "7 days"), ("_1month", "month", "1 month"),
                            ("_3month", "3month", "3 months"), ("", "6month", "6 months"), ("_12month", "year", "1 year")):
        _filter(f"F-7{tag}", lambda v, name=name: flt.time_filter(v, TS, relative=name),
                f"waktu_registrasi >= {LATEST} - INTERVAL '{span}'")
    _filter("F-8", lambda v: flt.last_before(v, TS, "3 MONTHS", as_of="2001-05-31"),
            "waktu_registrasi >= DATE '2001-05-31' - INTERVAL '3 months'")
    _filter("F-9", lambda v: flt.last_from_day(v, TS, "6 MONTHS"), SIX_MONTHS_DAY)
    _filter("F-10", lambda v: flt.last(v, TS, "6 MONTHS"), SIX_MONTHS)
    _filter("F-11", lambda v: flt.last_days_whole(v, TS, 180), DAYS_180)
    _filter("F-12", lambda v: flt.last(v, TS, "1 DAY"), f"waktu_registrasi >= {LATEST} - INTERVAL '1 day'")
    _filter("F-13", lambda v: flt.latest_month(v, TS), LATEST_MONTH)
    _filter("F-14", lambda v: flt.latest_month(flt.equals(v, jenis_registrasi="Rawat Jalan"), TS, anchor=v),
            f"{LATEST_MONTH} AND jenis_registrasi = 'Rawat Jalan'")
    _filter("F-14_region", lambda v: flt.latest_month(flt.equals(v, provinsi="ASIA"), TS, anchor=v),
            f"{LATEST_MONTH} AND provinsi = 'ASIA'")
    _filter("F-15", lambda v: flt.between(v, TS, "1999-02-01", "1999-03-15"),
            "waktu_registrasi BETWEEN TIMESTAMP '1999-02-01' AND TIMESTAMP '1999-03-15'")
    _filter("F-16", lambda v: flt.time_filter(v, TS, year=2000, relative="month", start="1995-01-01", end="1995-02-01"), IN_YEAR)
    _filter("F-16_year_month", lambda v: flt.time_filter(v, TS, year=2000, month=5, relative="day"), IN_MONTH)
    _filter("F-16_range", lambda v: flt.time_filter(v, TS, month=3, start="1995-01-01", end="1995-02-01"),
            "waktu_registrasi BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-02-01'")
    _filter("F-16_none", lambda v: flt.time_filter(v, TS, start="1995-01-01"), "true")
    _filter("F-17", lambda v: flt.where(v, {
        "kabupaten": [DISTRICT, "NATION_5"], "jenis_kelamin": "Perempuan", "usia": {"moreEqual": 10, "less": 40},
        "rujukan": {"isin": ["A", "N"]}, "kategori_usia": {"equals": "BUILDING"}}),
        f"""kabupaten IN ('{DISTRICT}', 'NATION_5') AND jenis_kelamin = 'Perempuan' AND usia >= 10
            AND usia < 40 AND rujukan IN ('A', 'N') AND kategori_usia = 'BUILDING'""")
    _filter("F-17_bounds", lambda v: flt.where(v, {"usia": {"more": 10, "lessEqual": 40}, "rujukan": {"equal": "R"}}),
            "usia > 10 AND usia <= 40 AND rujukan = 'R'")
    _filter("F-17_empty", lambda v: flt.where(v, {"rujukan": {"isin": []}}), "false")
    _filter("F-18", lambda v: flt.equals(v, provinsi="ASIA"), "provinsi = 'ASIA'")
    on_visits("F-19", lambda v: flt.drop_incomplete(agg.count_by(v, "diagnosa_primer")),
              """SELECT diagnosa_primer, count(*) AS count FROM visits
                 WHERE diagnosa_primer IS NOT NULL GROUP BY 1""")


def _dense(key, freq, duckdb_unit, interval, label=None, where="true", keep=lambda v: v) -> None:
    """T-3/T-5: a dense series against a generated spine."""
    shown = label or "d"
    on_visits(
        key,
        lambda v: resample.labelled(
            resample.densify(agg.count_by(keep(v), bucketed(freq), out="n"), freq, ["n"]),
            freq, "end" if label else "start"),
        f"""WITH g AS (SELECT date_trunc('{duckdb_unit}', waktu_registrasi) AS b, count(*) AS n
                       FROM visits WHERE {where} GROUP BY 1),
              spine AS (SELECT unnest(generate_series((SELECT min(b) FROM g), (SELECT max(b) FROM g),
                        INTERVAL {interval})) AS d)
            SELECT strftime({shown}, '%Y-%m-%d') AS time_period, coalesce(n, 0) AS n
            FROM spine LEFT JOIN g ON d = b""",
    )


def register_time() -> None:
    for tag, args, unit in (("", (None, None), "year"), ("_year", (2000, None), "month"), ("_month", (2000, 5), "day")):
        on_visits(
            f"T-1{tag}",
            lambda v, args=args: resample.labelled(
                agg.count_by(flt.base_filter(v, year=args[0], month=args[1]), bucketed(dates.grain_for(*args)), out="n"), "D"),
            f"""SELECT {period(unit)}, count(*) AS n FROM visits
                WHERE {dict(zip(('year', 'month', 'day'), ('true', IN_YEAR, IN_MONTH)))[unit]} GROUP BY 1""",
        )
    for unit in ("day", "week", "month", "quarter", "year"):
        on_visits("T-2" if unit == "day" else f"T-2_by_{unit}", lambda v, unit=unit: resample.labelled(agg.count_by(v, bucketed(unit), out="n"), unit),
                  f"SELECT {period(unit)}, count(*) AS n FROM visits GROUP BY 1")
    _dense("T-3", "D", "day", "1 DAY")
    _dense("T-3_clinic", "D", "day", "1 DAY", where=f"nama_departemen = '{DEPARTMENT}'",
           keep=lambda v: flt.equals(v, nama_departemen=DEPARTMENT))
    _dense("T-4", "M", "month", "1 MONTH", "last_day(d)")
    _dense("T-4_by_year", "Y", "year", "1 YEAR", "d + INTERVAL 1 YEAR - INTERVAL 1 DAY")
    _dense("T-5", "W", "week", "7 DAYS", "d + INTERVAL 6 DAYS")
    _dense("T-5_quarter", "Q", "quarter", "3 MONTHS", "d + INTERVAL 3 MONTHS - INTERVAL 1 DAY")
    on_visits("T-5_two_months", lambda v: resample.labelled(agg.count_by(v, bucketed("2M"), out="n"), "2M"),
              """SELECT strftime(make_date(year(waktu_registrasi), (month(waktu_registrasi) - 1) // 2 * 2 + 1, 1),
                 '%Y-%m-%d') AS time_period, count(*) AS n FROM visits GROUP BY 1""")
    on_visits("T-5_three_days", lambda v: resample.labelled(agg.count_by(v, bucketed("3D"), out="n"), "3D"),
              """SELECT strftime(time_bucket(INTERVAL 3 DAYS, waktu_registrasi, TIMESTAMP '1970-01-01'),
                 '%Y-%m-%d') AS time_period, count(*) AS n FROM visits GROUP BY 1""")
    on_visits("T-6", lambda v: agg.count_by(v, dates.text_label(dates.bucket(TS, "month"), "yyyy-MM").alias("label"), out="n"),
              "SELECT strftime(waktu_registrasi, '%Y-%m') AS label, count(*) AS n FROM visits GROUP BY 1")
    on_visits(
        "T-7",
        lambda v: agg.count_by(
            v.select(*[c.alias(n) for n, c in dates.calendar_fields(TS).items()])
            .withColumn("tanggal", F.date_format("tanggal", "yyyy-MM-dd")), "tahun", "bulan", "tanggal", out="n"),
        """SELECT year(waktu_registrasi) AS tahun, month(waktu_registrasi) AS bulan,
           strftime(waktu_registrasi, '%Y-%m-%d') AS tanggal, count(*) AS n FROM visits GROUP BY 1, 2, 3""",
    )


def register_aggregates() -> None:
    on_visits("A-1", lambda v: agg.count_by(v, "diagnosa_primer"),
              "SELECT diagnosa_primer, count(*) AS count FROM visits GROUP BY 1")
    on_visits("A-2", lambda v: agg.count_non_null_by(v, "diagnosa_primer"),
              "SELECT diagnosa_primer, count(diagnosa_primer) AS count FROM visits GROUP BY 1")
    on_visits("A-3", lambda v: agg.count_by(v, "jenis_registrasi", "rujukan"),
              "SELECT jenis_registrasi, rujukan, count(*) AS count FROM visits GROUP BY 1, 2")
    on_visits("A-4", lambda v: agg.row_count(flt.equals(v, jenis_registrasi="IGD", diagnosa_primer=DIAGNOSIS)),
              f"SELECT count(*) AS count FROM visits WHERE jenis_registrasi = 'IGD' AND diagnosa_primer = '{DIAGNOSIS}'")
    on_visits("A-5", lambda v: agg.distinct_count(v, "no_registrasi"),
              "SELECT count(DISTINCT no_registrasi) AS count FROM visits")
    on_visits("A-6", lambda v: agg.distinct_count(v, "id_pasien", "fix_pasien_baru"),
              "SELECT fix_pasien_baru, count(DISTINCT id_pasien) AS count FROM visits GROUP BY 1")
    on_visits("A-7", lambda v: rounded(agg.sum_by(v, ["jenis_penjamin", "jenis_kelamin"], a=REVENUE, b=COST), "a", "b", digits=2),
              """SELECT jenis_penjamin, jenis_kelamin, round(sum(total_tagihan), 2) AS a,
                 round(sum(total_semua_hpp), 2) AS b FROM visits GROUP BY 1, 2""")
    on_visits("A-8", lambda v: rounded(agg.sum_by(flt.equals(v, nama_departemen=DEPARTMENT), ["diagnosa_primer"], a=REVENUE), "a"),
              f"""WITH g AS (SELECT nama_departemen, diagnosa_primer, sum(total_tagihan) AS a FROM visits GROUP BY 1, 2)
                  SELECT diagnosa_primer, round(a, 4) AS a FROM g WHERE nama_departemen = '{DEPARTMENT}'""")
    on_visits("A-9", lambda v: rounded(agg.sum_by(v, [], a=REVENUE, b=COST), "a", "b", digits=2),
              "SELECT round(sum(total_tagihan), 2) AS a, round(sum(total_semua_hpp), 2) AS b FROM visits")
    on_visits("A-10", lambda v: rounded(agg.sum_by(flt.latest_month(v, TS), [], a=REVENUE), "a"),
              f"SELECT round(sum(total_tagihan), 4) AS a FROM visits WHERE {LATEST_MONTH}")
    on_visits("A-11", lambda v: rounded(agg.profit(v, REVENUE, COST, "nama_departemen"), "profit"),
              """SELECT nama_departemen, round(sum(total_tagihan) - sum(total_semua_hpp), 4) AS profit
                 FROM visits GROUP BY 1""")
    on_visits("A-12", lambda v: rounded(agg.average_by(v, ["kelas_hak"], a="los_rawatan", b=REVENUE), "a", "b"),
              """SELECT kelas_hak, round(avg(los_rawatan), 4) AS a, round(avg(total_tagihan), 4) AS b
                 FROM visits GROUP BY 1""")
    on_visits("A-13",
              lambda v: agg.count_by(v.select("los_rawatan", bankers_round(F.col("los_rawatan") / 2).alias("r")), "los_rawatan", "r", out="n"),
              "SELECT los_rawatan, round_even(los_rawatan / 2, 0) AS r, count(*) AS n FROM visits GROUP BY 1, 2")
    on_visits("A-14", lambda v: agg.mode_by(v, ["nama_departemen"], "diagnosa_primer", "m", count_out="n"),
              """SELECT nama_departemen, mode() WITHIN GROUP (ORDER BY diagnosa_primer) AS m, count(*) AS n
                 FROM visits GROUP BY 1""")
    on_visits("A-15", lambda v: agg.mode_of(agg.mode_by(v, [bucketed("day")], "kategori_usia", "m"), "m", "overall"),
              """WITH d AS (SELECT mode() WITHIN GROUP (ORDER BY kategori_usia) AS m FROM visits
                            GROUP BY date_trunc('day', waktu_registrasi))
                 SELECT mode() WITHIN GROUP (ORDER BY m) AS overall FROM d""")
    on_visits("A-16", lambda v: agg.time_extent(v).select(*[dates.text_label(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("min_time", "max_time")]),
              """SELECT strftime(min(waktu_registrasi), '%Y-%m-%d %H:%M:%S') AS min_time,
                 strftime(max(waktu_registrasi), '%Y-%m-%d %H:%M:%S') AS max_time FROM visits""")
    on_visits("A-17", lambda v: agg.distinct_values(v, "kabupaten"), "SELECT DISTINCT kabupaten FROM visits")
    on_visits("A-18", agg.observed_calendar,
              "SELECT DISTINCT year(waktu_registrasi) AS tahun, month(waktu_registrasi) AS bulan FROM visits")
    on_visits("A-18_range", agg.year_range,
              """SELECT unnest(generate_series(year(min(waktu_registrasi)), year(max(waktu_registrasi)))) AS tahun
                 FROM visits""")
    for name, fn in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max")):
        on_visits("A-19" if name == "sum" else f"A-19_{name}",
                  lambda v, name=name: rounded(agg.aggregate_columns(v, [REVENUE, "los_rawatan"], name), REVENUE, "los_rawatan", digits=2),
                  f"""SELECT round({fn}(total_tagihan), 2) AS total_tagihan,
                      round({fn}(los_rawatan), 2) AS los_rawatan FROM visits""")
    on_visits("A-20",
              lambda v: rounded(agg.aggregate_columns(resample.densify(
                  agg.count_by(v, bucketed("day"), out="n"), "D", ["n"]), ["n"], "mean"), "n"),
              """WITH g AS (SELECT date_trunc('day', waktu_registrasi) AS b, count(*) AS n FROM visits GROUP BY 1)
                 SELECT round(sum(n) / (date_diff('day', min(b), max(b)) + 1), 4) AS n FROM g""")
    on_visits("A-21",
              lambda v: rounded(agg.as_index_value(agg.aggregate_columns(v, [REVENUE, COST], "sum"), [REVENUE, COST]), "value", digits=2),
              """SELECT 'total_tagihan' AS index, round(sum(total_tagihan), 2) AS value FROM visits UNION ALL
                 SELECT 'total_semua_hpp', round(sum(total_semua_hpp), 2) FROM visits""")
    on_visits("A-22", lambda v: agg.frequency(v, ["jenis_registrasi", "diagnosa_primer"]),
              """SELECT jenis_registrasi, diagnosa_primer, count(*) AS count FROM visits
                 WHERE diagnosa_primer IS NOT NULL GROUP BY 1, 2""")
    on_visits("A-23", lambda v: agg.breakdown_json(v, "diagnosa_primer", "diagnosa", "diagnosa_counts"),
              """WITH g AS (SELECT diagnosa_primer, count(*) AS n FROM visits GROUP BY 1)
                 SELECT CAST(to_json(list({'diagnosa': diagnosa_primer, 'count': n}
                   ORDER BY n DESC, diagnosa_primer NULLS FIRST)) AS VARCHAR) AS diagnosa_counts FROM g""")
    on_visits("A-24",
              lambda v: agg.nested_records(v, "kategori_usia", "jenis_penjamin").selectExpr("kategori_usia", "to_json(records) AS records"),
              """WITH g AS (SELECT kategori_usia, jenis_penjamin, count(*) AS kunjungan FROM visits GROUP BY 1, 2)
                 SELECT kategori_usia, CAST(to_json(list({'jenis_penjamin': jenis_penjamin, 'kunjungan': kunjungan}
                   ORDER BY jenis_penjamin)) AS VARCHAR) AS records FROM g GROUP BY 1""")


def register_ranking() -> None:
    on_visits("R-1", lambda v: rank.top_k(agg.count_by(v, "diagnosa_primer"), "count", ["diagnosa_primer"]),
              """SELECT diagnosa_primer, count(*) AS count FROM visits GROUP BY 1
                 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 10""")
    on_visits("R-2", lambda v: rounded(rank.top_k(agg.sum_by(v, ["pekerjaan"], total=COST), "total", ["pekerjaan"]), "total"),
              """SELECT pekerjaan, round(sum(total_semua_hpp), 4) AS total FROM visits GROUP BY 1
                 ORDER BY sum(total_semua_hpp) DESC NULLS FIRST, 1 LIMIT 10""")
    on_visits("R-3", lambda v: rank.bottom_k(agg.count_by(v, "pekerjaan"), "count", ["pekerjaan"]),
              """SELECT pekerjaan, count(*) AS count FROM visits GROUP BY 1 ORDER BY 2, 1 DESC LIMIT 10""")
    on_visits("R-4",
              lambda v: rounded(rank.ranked(agg.sum_by(v, ["diagnosa_primer"], total=REVENUE), "total", ["diagnosa_primer"]), "total"),
              "SELECT diagnosa_primer, round(sum(total_tagihan), 4) AS total FROM visits GROUP BY 1")
    for sort in ("pendapatan", "pengeluaran"):
        on_visits("R-5" if sort == "pengeluaran" else "R-5_revenue",
                  lambda v, sort=sort: rounded(rank.top_k(
                      agg.sum_by(v, ["kabupaten"], pendapatan=REVENUE, pengeluaran=COST),
                      rank.sort_measure(sort, ["pendapatan", "pengeluaran"]), ["kabupaten"], 5), "pendapatan", "pengeluaran"),
                  f"""WITH g AS (SELECT kabupaten, sum(total_tagihan) AS pendapatan, sum(total_semua_hpp) AS pengeluaran
                      FROM visits GROUP BY 1)
                      SELECT kabupaten, round(pendapatan, 4) AS pendapatan, round(pengeluaran, 4) AS pengeluaran
                      FROM g ORDER BY g.{sort} DESC, kabupaten LIMIT 5""")
    on_visits("R-6", lambda v: agg.count_by(rank.distinct_on(v, ["id_pasien", "kategori_usia"]), "kategori_usia"),
              """SELECT kategori_usia, count(*) AS count FROM
                 (SELECT DISTINCT ON (id_pasien, kategori_usia) kategori_usia FROM visits) GROUP BY 1""")
    on_visits("R-7", lambda v: rank.first_event(v, "id_pasien", TS, "t").withColumn("t", dates.text_label("t")),
              """SELECT id_pasien, strftime(min(waktu_registrasi), '%Y-%m-%d') AS t FROM visits GROUP BY 1""")
    on_visits("R-8", lambda v: agg.count_by(rank.distinct_on(v, ["id_pasien", "jenis_kelamin", bucketed("month")]), "jenis_kelamin"),
              """SELECT jenis_kelamin, count(*) AS count FROM (SELECT DISTINCT id_pasien, jenis_kelamin,
                 date_trunc('month', waktu_registrasi) AS b FROM visits) GROUP BY 1""")
    firsts = ["id_registrasi", "jenis_registrasi", REVENUE]
    on_visits("R-9",
              lambda v: rank.first_per_key(v, ["id_pasien"], TS, firsts).withColumn(TS, dates.text_label(TS)),
              """SELECT id_pasien, strftime(waktu_registrasi, '%Y-%m-%d') AS waktu_registrasi, id_registrasi,
                 jenis_registrasi, total_tagihan FROM (SELECT *, row_number() OVER (PARTITION BY id_pasien
                   ORDER BY waktu_registrasi, id_registrasi, jenis_registrasi, total_tagihan) AS rn FROM visits)
                 WHERE rn = 1""")
    on_visits("R-10", lambda v: agg.row_count(rank.limit(v.select("id_registrasi"), 1000)),
              "SELECT count(*) AS count FROM (SELECT id_registrasi FROM visits LIMIT 1000)")


def register_joins() -> None:
    on_visits("J-1", lambda v: rounded(agg.sum_by(flt.latest_month(flt.equals(v, jenis_registrasi="IGD"), TS, anchor=v), ["jenis_penjamin"], total=REVENUE), "total"),
              """WITH m AS (SELECT year(max(waktu_registrasi)) AS y, month(max(waktu_registrasi)) AS mo FROM visits)
                 SELECT jenis_penjamin, round(sum(total_tagihan), 4) AS total FROM visits, m
                 WHERE year(waktu_registrasi) = y AND month(waktu_registrasi) = mo AND jenis_registrasi = 'IGD'
                 GROUP BY 1""")
    on_visits("J-2", lambda v: agg.count_by(flt.last(v, TS, "1 DAY"), "jenis_penjamin"),
              f"""SELECT jenis_penjamin, count(*) AS count FROM visits
                  WHERE waktu_registrasi >= {LATEST} - INTERVAL '1 day' GROUP BY 1""")
    on_visits("J-3",
              lambda v: agg.count_by(v, "nama_departemen").withColumn("all_visits", agg.row_count(v).scalar()),
              """SELECT nama_departemen, count(*) AS count, (SELECT count(*) FROM visits) AS all_visits
                 FROM visits GROUP BY 1""")

    def counts_at_rows(v):
        out = cube_series(v, TS, ["jenis_registrasi"], [REVENUE], freq="M", labels=TYPES, compat=True)
        return resample.labelled(rounded(out, REVENUE, digits=2), "M")

    on_visits("J-4", counts_at_rows,
              f"""WITH c AS (SELECT waktu_registrasi, {counts(TYPES, 'jenis_registrasi', True)} FROM visits GROUP BY 1)
                  SELECT {period('month')}, {', '.join(f'CAST(sum(c."{t}") AS BIGINT) AS "{t}"' for t in TYPES)},
                    round(sum(total_tagihan), 2) AS total_tagihan
                  FROM visits JOIN c USING (waktu_registrasi) GROUP BY 1""")

    def aligned(v):
        days = resample.densify(agg.count_by(v, bucketed("day"), out="n"), "D", ["n"]).select(PERIOD)
        ages = agg.mode_by(flt.equals(v, nama_departemen=DEPARTMENT), [bucketed("day")], "kategori_usia", "dominant_age")
        return resample.labelled(resample.align(days, ages), "D")

    on_visits("J-5", aligned,
              f"""WITH d AS (SELECT date_trunc('day', waktu_registrasi) AS b,
                        mode() WITHIN GROUP (ORDER BY kategori_usia) AS dominant_age
                      FROM visits WHERE nama_departemen = '{DEPARTMENT}' GROUP BY 1),
                    spine AS (SELECT unnest(generate_series((SELECT min(date_trunc('day', waktu_registrasi)) FROM visits),
                      (SELECT max(date_trunc('day', waktu_registrasi)) FROM visits), INTERVAL 1 DAY)) AS day)
                  SELECT strftime(day, '%Y-%m-%d') AS time_period, dominant_age FROM spine LEFT JOIN d ON day = b""")
    on_visits("U-1",
              lambda v: agg.count_by(reshape.union_rows(
                  flt.in_year(v, TS, 2000).select("jenis_registrasi", "rujukan"), v.select("jenis_registrasi", "kabupaten")),
                  "jenis_registrasi", "rujukan", "kabupaten"),
              f"""SELECT jenis_registrasi, rujukan, kabupaten, count(*) AS count FROM (
                    SELECT jenis_registrasi, rujukan, NULL AS kabupaten FROM visits WHERE {IN_YEAR}
                    UNION ALL SELECT jenis_registrasi, NULL, kabupaten FROM visits) GROUP BY 1, 2, 3""")


def register_reshape() -> None:
    on_visits("P-1", lambda v: resample.labelled(reshape.pivot_count(v, [bucketed("day")], "kategori_usia"), "D"),
              f"SELECT {period('day')}, {counts(AGES, 'kategori_usia')} FROM visits GROUP BY 1")
    sums = ", ".join(f"round(sum(total_semua_hpp) FILTER (WHERE jenis_registrasi = '{t}'), 4) AS \"{t}\"" for t in TYPES)
    on_visits("P-2", lambda v: resample.labelled(rounded(reshape.pivot_measure(v, [bucketed("day")], "jenis_registrasi", F.sum(COST), TYPES), *TYPES), "D"),
              f"SELECT {period('day')}, {sums} FROM visits GROUP BY 1")
    means = ", ".join(f"coalesce(avg(total_tagihan) FILTER (WHERE jenis_registrasi = '{t}'), 0) AS \"{t}\"" for t in TYPES)
    for name, fn in (("sum", F.sum), ("mean", F.avg)):
        sql_fn = "avg" if name == "mean" else "sum"
        on_visits("P-3" if name == "sum" else f"P-3_{name}",
                  lambda v, fn=fn: resample.labelled(rounded(reshape.pivot_mean_then(
                      v, TS, dates.bucket(TS, "month"), "jenis_registrasi", [REVENUE], TYPES, fn), *TYPES, nudge=1e-6), "M"),
                  f"""WITH t AS (SELECT waktu_registrasi, {means} FROM visits GROUP BY 1)
                      SELECT {period('month')}, {', '.join(f'round({sql_fn}("{t}") + 1e-6, 4) AS "{t}"' for t in TYPES)}
                      FROM t GROUP BY 1""")
    filled = ", ".join(f'coalesce("{t}", 0) AS "{t}"' for t in TYPES)
    on_visits("P-4",
              lambda v: resample.labelled(resample.densify(reshape.pivot_count(
                  flt.equals(v, nama_departemen=DEPARTMENT), [bucketed("day")], "jenis_registrasi", TYPES, fill=True), "D", TYPES), "D"),
              f"""WITH g AS (SELECT date_trunc('day', waktu_registrasi) AS b, {counts(TYPES, 'jenis_registrasi', True)}
                      FROM visits WHERE nama_departemen = '{DEPARTMENT}' GROUP BY 1),
                    spine AS (SELECT unnest(generate_series((SELECT min(b) FROM g), (SELECT max(b) FROM g), INTERVAL 1 DAY)) AS d)
                  SELECT strftime(d, '%Y-%m-%d') AS time_period, {filled} FROM spine LEFT JOIN g ON d = b""")

    def payload(v):
        wide = reshape.pivot_count(v, [bucketed("month")], "jenis_registrasi", TYPES, fill=True)
        out = reshape.columnar_payload(wide, columns=TYPES, pattern="yyyy-MM-dd")
        return out.select(F.to_json("index").alias("index"), F.to_json("columns").alias("columns"), F.to_json("values").alias("values"))

    on_visits("P-5", payload,
              f"""WITH g AS (SELECT {period('month')}, {counts(TYPES, 'jenis_registrasi', True)} FROM visits GROUP BY 1)
                  SELECT CAST(to_json(list(time_period ORDER BY time_period)) AS VARCHAR) AS index,
                    CAST(to_json({TYPES}) AS VARCHAR) AS columns,
                    CAST(to_json([{', '.join(f'list(CAST("{t}" AS DOUBLE) ORDER BY time_period)' for t in TYPES)}]) AS VARCHAR) AS values
                  FROM g""")
    on_visits("P-6", lambda v: resample.labelled(reshape.pivot_count(flt.equals(v, nama_departemen=DEPARTMENT), [bucketed("day")], "kategori_usia", fill=True), "D"),
              f"""SELECT {period('day')}, {counts(AGES, 'kategori_usia', True)} FROM visits
                  WHERE nama_departemen = '{DEPARTMENT}' GROUP BY 1""")
    on_visits("P-7", lambda v: rounded(reshape.category_mean_totals(v, ["kelas_hak"], [REVENUE, COST]), "value"),
              "SELECT kelas_hak, round(avg(total_tagihan) + avg(total_semua_hpp), 4) AS value FROM visits GROUP BY 1")
    pairs = [f"{g}|{t}" for g in ("Laki-laki", "Perempuan") for t in TYPES]
    cells = ", ".join(f"count(*) FILTER (WHERE jenis_kelamin || '|' || jenis_registrasi = '{p}') AS \"{p}\"" for p in pairs)
    on_visits("P-8", lambda v: resample.labelled(reshape.unstack_count(v, [bucketed("month")], ["jenis_kelamin", "jenis_registrasi"]), "M"),
              f"SELECT {period('month')}, {cells} FROM visits GROUP BY 1")


def register() -> None:
    register_filters()
    register_time()
    register_aggregates()
    register_ranking()
    register_joins()
    register_reshape()
