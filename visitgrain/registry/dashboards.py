"""Q-*: the dashboard queries, unfiltered and with the filters each accepts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from visitgrain.operators import reshape
from visitgrain.plans import geography, patients, revenue, rolled, utility, visits as vis
from visitgrain.registry.core import ORACLES, add, on_visits, rounded
from visitgrain.sources.visits import visits

TYPES = ["IGD", "Rawat Inap", "Rawat Jalan"]
GENDERS = ["Laki-laki", "Perempuan"]
REFERRALS = ["A", "N", "R"]
AGES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
DISTRICT, DEPARTMENT, DIAGNOSIS = "NATION_3", "Brand#19", "SMALL-28"
YEAR = {"year": 2000}
YEAR_MONTH = {"year": 2000, "month": 5}
FILTERED = {"year": 2000, "district": DISTRICT}

# SQL fragments, one per filter set above.
IN_YEAR = "year(waktu_registrasi) = 2000"
IN_MONTH = "year(waktu_registrasi) = 2000 AND month(waktu_registrasi) = 5"
IN_FILTERED = "year(waktu_registrasi) = 2000 AND kabupaten = 'NATION_3'"
LATEST_MONTH = "waktu_registrasi >= (SELECT date_trunc('month', max(waktu_registrasi)) FROM visits)"
SIX_MONTHS = "waktu_registrasi >= (SELECT max(waktu_registrasi) FROM visits) - INTERVAL '6 months'"
SIX_MONTHS_DAY = "waktu_registrasi >= (SELECT CAST(max(waktu_registrasi) AS DATE) FROM visits) - INTERVAL '6 months'"
DAYS_180 = "waktu_registrasi >= (SELECT CAST(max(waktu_registrasi) - INTERVAL '180 days' AS DATE) FROM visits)"


def period(unit: str) -> str:
    return f"strftime(date_trunc('{unit}', waktu_registrasi), '%Y-%m-%d') AS time_period"


def counts(labels: list[str], column: str, zero: bool = False) -> str:
    """One conditional count per label; 0 becomes null unless ``zero``."""
    cell = "count(*) FILTER (WHERE {c} = '{l}')"
    cell = cell if zero else f"nullif({cell}, 0)"
    return ", ".join(f"{cell.format(c=column, l=label)} AS \"{label}\"" for label in labels)


def series_count(where: str, unit: str) -> str:
    return f"SELECT {period(unit)}, count(*) AS jumlah_kunjungan FROM visits WHERE {where} GROUP BY 1"


def series_pivot(where: str, unit: str, labels: list[str], column: str, zero: bool = False) -> str:
    return f"SELECT {period(unit)}, {counts(labels, column, zero)} FROM visits WHERE {where} GROUP BY 1"


# Every filter set with the bucket its series gets and its SQL condition.
SETS = [
    ("_year", YEAR, "month", IN_YEAR),
    ("_month", YEAR_MONTH, "day", IN_MONTH),
    ("_district", FILTERED, "month", IN_FILTERED),
]
ALL = [("", {}, "year", "true"), *SETS]


def _labels(v: DataFrame, column: str, filters: dict) -> list[str] | None:
    """Columns of a filtered pivot: the labels of the whole table, so that they stay the same."""
    return reshape.categories(v, column) if filters else None


def register_visits() -> None:
    for tag, kw, unit, cond in [("", {}, "day", SIX_MONTHS_DAY), *SETS]:
        on_visits(f"Q-1{tag}", lambda v, kw=kw: vis.growth(v, **kw), series_count(cond, unit))
    on_visits("Q-2", vis.growth_per_year, series_count("true", "year"))
    for tag, kw, unit, cond in ALL:
        on_visits(
            f"Q-3{tag}", lambda v, kw=kw: vis.by_referral(v, values=_labels(v, "rujukan", kw), **kw),
            series_pivot(cond, unit, REFERRALS, "rujukan"),
        )
        on_visits(
            f"Q-4{tag}", lambda v, kw=kw: vis.by_age(v, values=_labels(v, "kategori_usia", kw), **kw),
            series_pivot(cond, unit, AGES, "kategori_usia"),
        )
    for tag, kw, unit, cond in [("", {}, "day", DAYS_180), *SETS]:
        on_visits(
            f"Q-5{tag}", lambda v, kw=kw: vis.by_registration_type(v, values=TYPES, **kw),
            series_pivot(cond, unit, TYPES, "jenis_registrasi", zero=True),
        )
    for tag, kw, _, cond in ALL:
        on_visits(
            f"Q-7{tag}", lambda v, kw=kw: vis.per_registration_type(v, **kw),
            f"SELECT jenis_registrasi, count(*) AS count FROM visits WHERE {cond} GROUP BY 1",
        )
        on_visits(
            f"Q-8{tag}", lambda v, kw=kw: vis.top_clinics(v, **kw),
            f"""SELECT nama_departemen, count(*) AS count FROM visits
                WHERE jenis_registrasi = 'Rawat Jalan' AND {cond}
                GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 10""",
        )
        on_visits(
            f"Q-9{tag}", lambda v, kw=kw: vis.top_diagnoses(v, **kw),
            f"""SELECT diagnosa_primer, count(*) AS count FROM visits WHERE {cond}
                GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 10""",
        )
        on_visits(
            f"Q-11{tag}", lambda v, kw=kw: vis.per_payer(v, **kw),
            f"SELECT jenis_penjamin, count(*) AS count FROM visits WHERE {cond} GROUP BY 1",
        )
        on_visits(
            f"Q-12{tag}",
            lambda v, kw=kw: vis.registration_by_referral(v, **kw).selectExpr(
                "jenis_registrasi", "to_json(records) AS records"
            ),
            f"""WITH g AS (SELECT jenis_registrasi, rujukan, count(*) AS kunjungan FROM visits
                           WHERE {cond} GROUP BY 1, 2)
                SELECT jenis_registrasi,
                  CAST(to_json(list({{'rujukan': rujukan, 'kunjungan': kunjungan}} ORDER BY rujukan))
                    AS VARCHAR) AS records
                FROM g GROUP BY 1""",
        )
        on_visits(
            f"Q-13{tag}", lambda v, kw=kw: vis.diagnoses_of(v, "Rawat Inap", **kw),
            f"""SELECT diagnosa_primer, count(*) AS count FROM visits
                WHERE jenis_registrasi = 'Rawat Inap' AND diagnosa_primer IS NOT NULL AND {cond}
                GROUP BY 1""",
        )
        on_visits(
            f"Q-14{tag}", lambda v, kw=kw: vis.diagnosis_count(v, "IGD", DIAGNOSIS, **kw),
            f"""SELECT count(*) AS count FROM visits WHERE jenis_registrasi = 'IGD'
                AND diagnosa_primer = '{DIAGNOSIS}' AND {cond}""",
        )
        on_visits(
            f"Q-16{tag}", lambda v, kw=kw: vis.departments(v, **kw),
            f"SELECT nama_departemen, count(*) AS count FROM visits WHERE {cond} GROUP BY 1",
        )
        on_visits(
            f"Q-17{tag}", lambda v, kw=kw: vis.department_detail(v, DEPARTMENT, **kw),
            f"""WITH g AS (SELECT diagnosa_primer, count(*) AS n FROM visits
                           WHERE nama_departemen = '{DEPARTMENT}' AND {cond} GROUP BY 1)
                SELECT '{DEPARTMENT}' AS nama_departemen, CAST(coalesce(sum(n), 0) AS BIGINT) AS count,
                  CAST(to_json(list({{'diagnosa': diagnosa_primer, 'count': n}}
                    ORDER BY n DESC, diagnosa_primer NULLS FIRST)) AS VARCHAR) AS diagnosa_counts
                FROM g""",
        )
        for key, plan, where in [
            ("Q-15", lambda v, kw: vis.diagnosis_over_time(v, "IGD", DIAGNOSIS, **kw),
             f"jenis_registrasi = 'IGD' AND diagnosa_primer = '{DIAGNOSIS}' AND {cond}"),
            ("Q-18", lambda v, kw: vis.department_over_time(v, DEPARTMENT, **kw),
             f"nama_departemen = '{DEPARTMENT}' AND {cond}"),
        ]:
            unit = {"": "year", "_year": "month", "_month": "day", "_district": "month"}[tag]
            on_visits(
                f"{key}{tag}", lambda v, kw=kw, plan=plan: plan(v, kw),
                f"""WITH s AS (SELECT {period(unit)}, count(*) AS count,
                      mode() WITHIN GROUP (ORDER BY kategori_usia) AS dominant_age
                      FROM visits WHERE {where} GROUP BY 1)
                    SELECT *, (SELECT mode() WITHIN GROUP (ORDER BY dominant_age) FROM s)
                      AS dominant_age_summary FROM s""",
            )
    on_visits(
        "Q-10", vis.distinct_visits,
        f"SELECT count(DISTINCT no_registrasi) AS count FROM visits WHERE {LATEST_MONTH}",
    )
    for tag, kw, _, cond in SETS:
        on_visits(
            f"Q-10{tag}", lambda v, kw=kw: vis.distinct_visits(v, **kw),
            f"SELECT count(DISTINCT no_registrasi) AS count FROM visits WHERE {cond}",
        )
    # Pandas-style series: empty buckets present, named by their last day.
    on_visits(
        "Q-1_dense", lambda v: vis.growth(v, dense=True, label="end", **YEAR_MONTH),
        f"""WITH g AS (SELECT date_trunc('day', waktu_registrasi) AS d, count(*) AS n FROM visits
                       WHERE {IN_MONTH} GROUP BY 1),
              spine AS (SELECT unnest(generate_series((SELECT min(d) FROM g), (SELECT max(d) FROM g),
                        INTERVAL 1 DAY)) AS d)
            SELECT strftime(spine.d, '%Y-%m-%d') AS time_period, coalesce(n, 0) AS jumlah_kunjungan
            FROM spine LEFT JOIN g ON spine.d = g.d""",
    )
    on_visits(
        "Q-2_dense", lambda v: vis.growth_per_year(v, dense=True, label="end"),
        """SELECT year(waktu_registrasi) || '-12-31' AS time_period, count(*) AS jumlah_kunjungan
           FROM visits GROUP BY 1""",
    )


def register_patients() -> None:
    for tag, kw, _, cond in [("", {}, "", LATEST_MONTH), *SETS]:
        on_visits(
            f"Q-19{tag}", lambda v, kw=kw: patients.by_gender(v, **kw),
            f"""SELECT jenis_kelamin, count(*) AS count FROM
                (SELECT DISTINCT id_pasien, jenis_kelamin FROM visits WHERE {cond}) GROUP BY 1""",
        )
        on_visits(
            f"Q-22{tag}", lambda v, kw=kw: patients.unique_patients(v, **kw),
            f"SELECT count(DISTINCT id_pasien) AS count FROM visits WHERE {cond}",
        )
        on_visits(
            f"Q-24{tag}", lambda v, kw=kw: patients.new_and_returning(v, **kw),
            f"""SELECT k AS kategori, count(DISTINCT id_pasien) AS count
                FROM (VALUES ('t', 'Pasien Baru'), ('f', 'Pasien Lama')) AS l(f, k)
                LEFT JOIN (SELECT * FROM visits WHERE {cond}) v ON v.fix_pasien_baru = l.f
                GROUP BY 1""",
        )
    for tag, kw, unit, cond in ALL:
        on_visits(
            f"Q-20{tag}", lambda v, kw=kw: patients.by_gender_over_time(v, values=GENDERS, **kw),
            f"""SELECT time_period, {counts(GENDERS, 'jenis_kelamin')} FROM
                (SELECT DISTINCT id_pasien, jenis_kelamin, {period(unit)} FROM visits WHERE {cond})
                GROUP BY 1""",
        )
        on_visits(
            f"Q-21{tag}", lambda v, kw=kw: patients.top_occupations(v, **kw),
            f"""SELECT pekerjaan, count(*) AS count FROM visits WHERE {cond}
                GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
        )
        on_visits(
            f"Q-21_rarest{tag}", lambda v, kw=kw: patients.rarest_occupations(v, **kw),
            f"""SELECT pekerjaan, count(*) AS count FROM visits WHERE {cond}
                GROUP BY 1 ORDER BY 2, 1 DESC LIMIT 10""",
        )
        on_visits(
            f"Q-25{tag}", lambda v, kw=kw: patients.by_age(v, **kw),
            f"""SELECT kategori_usia, count(*) AS count FROM
                (SELECT DISTINCT id_pasien, kategori_usia FROM visits WHERE {cond}) GROUP BY 1""",
        )
    first_years = """SELECT year(t) AS tahun, count(*) AS count FROM
        (SELECT id_pasien, min(waktu_registrasi) AS t FROM visits WHERE {c} GROUP BY 1) GROUP BY 1"""
    on_visits("Q-23", patients.new_per_year, first_years.format(c="true"))
    on_visits(
        "Q-23_district", lambda v: patients.new_per_year(v, district=DISTRICT),
        first_years.format(c=f"kabupaten = '{DISTRICT}'"),
    )
    on_visits(
        "Q-24_rows", lambda v: patients.new_and_returning(v, count="rows", **YEAR),
        f"""SELECT CASE fix_pasien_baru WHEN 't' THEN 'Pasien Baru' ELSE 'Pasien Lama' END AS kategori,
            count(*) AS count FROM visits WHERE {IN_YEAR} GROUP BY 1""",
    )


SUMS = """round(sum(total_tagihan), 4) AS pendapatan, round(sum(total_semua_hpp), 4) AS pengeluaran"""


def both(df):
    return rounded(df, "pendapatan", "pengeluaran")


def register_revenue() -> None:
    pivot = ", ".join(
        f"coalesce(round(sum(total_tagihan) FILTER (WHERE jenis_registrasi = '{t}'), 2), 0) AS \"{t}\""
        for t in TYPES
    )
    for tag, kw, unit, cond in [("", {}, "day", SIX_MONTHS), *SETS]:
        on_visits(
            f"Q-26{tag}",
            lambda v, kw=kw: rounded(revenue.by_registration_type(v, values=TYPES, **kw), *TYPES, digits=2),
            f"SELECT {period(unit)}, {pivot} FROM visits WHERE {cond} GROUP BY 1",
        )
        on_visits(
            f"Q-46{tag}",
            lambda v, kw=kw: rounded(revenue.over_time(v, **kw), "total_tagihan", "total_semua_hpp"),
            f"""SELECT {period(unit)}, round(sum(total_tagihan), 4) AS total_tagihan,
                round(sum(total_semua_hpp), 4) AS total_semua_hpp
                FROM visits WHERE {cond} GROUP BY 1""",
        )
    for tag, kw, _, cond in ALL:
        on_visits(
            f"Q-28{tag}", lambda v, kw=kw: rounded(revenue.revenue_per_payer(v, **kw), "total", digits=2),
            f"SELECT jenis_penjamin, round(sum(total_tagihan), 2) AS total FROM visits WHERE {cond} GROUP BY 1",
        )
        on_visits(
            f"Q-29{tag}", lambda v, kw=kw: rounded(revenue.cost_per_payer(v, **kw), "total", digits=2),
            f"SELECT jenis_penjamin, round(sum(total_semua_hpp), 2) AS total FROM visits WHERE {cond} GROUP BY 1",
        )
        on_visits(
            f"Q-30{tag}",
            lambda v, kw=kw: rounded(revenue.both_per_payer(v, **kw), "pendapatan", "pengeluaran", digits=2),
            f"""SELECT jenis_penjamin, round(sum(total_tagihan), 2) AS pendapatan,
                round(sum(total_semua_hpp), 2) AS pengeluaran FROM visits WHERE {cond} GROUP BY 1""",
        )
        on_visits(
            f"Q-34{tag}",
            lambda v, kw=kw: rounded(revenue.totals(v, **kw), "pendapatan", "pengeluaran", digits=2),
            f"""SELECT round(sum(total_tagihan), 2) AS pendapatan,
                round(sum(total_semua_hpp), 2) AS pengeluaran FROM visits WHERE {cond}""",
        )
        on_visits(
            f"Q-35{tag}", lambda v, kw=kw: rounded(revenue.revenue_per_diagnosis(v, **kw), "pendapatan"),
            f"""SELECT diagnosa_primer, round(sum(total_tagihan), 4) AS pendapatan
                FROM visits WHERE {cond} GROUP BY 1""",
        )
        on_visits(
            f"Q-36{tag}", lambda v, kw=kw: rounded(revenue.cost_per_diagnosis(v, **kw), "pengeluaran"),
            f"""SELECT diagnosa_primer, round(sum(total_semua_hpp), 4) AS pengeluaran
                FROM visits WHERE {cond} GROUP BY 1""",
        )
        on_visits(
            f"Q-37{tag}", lambda v, kw=kw: both(revenue.diagnosis_payers(v, DIAGNOSIS, **kw)),
            f"""SELECT jenis_penjamin, {SUMS} FROM visits
                WHERE diagnosa_primer = '{DIAGNOSIS}' AND {cond} GROUP BY 1""",
        )
        on_visits(
            f"Q-38{tag}",
            lambda v, kw=kw: rounded(
                revenue.diagnosis_room_classes(v, DIAGNOSIS, **kw), "pendapatan", "pengeluaran", "avg_los"
            ),
            f"""WITH f AS (SELECT * FROM visits WHERE diagnosa_primer = '{DIAGNOSIS}'
                           AND jenis_registrasi = 'Rawat Inap' AND {cond})
                SELECT kelas_hak, {SUMS}, round(avg(los_rawatan), 4) AS avg_los,
                  (SELECT coalesce(round_even(avg(los_rawatan), 0), 0) FROM f) AS avg_los_rawatan
                FROM f GROUP BY 1""",
        )
        for by, sort in (("", "pendapatan"), ("_by_cost", "pengeluaran")):
            on_visits(
                f"Q-39{by}{tag}",
                lambda v, kw=kw, sort=sort: both(revenue.all_diagnoses(v, sort=sort, **kw)),
                f"""SELECT diagnosa_primer, {SUMS} FROM visits
                    WHERE diagnosa_primer IS NOT NULL AND {cond} GROUP BY 1""",
            )
            on_visits(
                f"Q-42{by}{tag}",
                lambda v, kw=kw, sort=sort: both(revenue.all_clinics(v, sort=sort, **kw)),
                f"SELECT nama_departemen, {SUMS} FROM visits WHERE {cond} GROUP BY 1",
            )
        on_visits(
            f"Q-40{tag}", lambda v, kw=kw: both(revenue.clinic_diagnoses(v, DEPARTMENT, **kw)),
            f"""SELECT diagnosa_primer, {SUMS} FROM visits
                WHERE nama_departemen = '{DEPARTMENT}' AND {cond} GROUP BY 1""",
        )
        on_visits(
            f"Q-41{tag}", lambda v, kw=kw: both(revenue.clinic_payers(v, DEPARTMENT, **kw)),
            f"""SELECT jenis_penjamin, {SUMS} FROM visits
                WHERE nama_departemen = '{DEPARTMENT}' AND {cond} GROUP BY 1""",
        )
        for key, sort in (("Q-43", "pendapatan"), ("Q-44", "pengeluaran")):
            on_visits(
                f"{key}{tag}", lambda v, kw=kw, sort=sort: both(revenue.top_clinics(v, sort=sort, **kw)),
                f"""SELECT nama_departemen, {SUMS} FROM visits WHERE {cond} GROUP BY 1
                    ORDER BY {sort} DESC NULLS FIRST, 1 LIMIT 10""",
            )
    on_visits(
        "Q-31", lambda v: both(revenue.last_day(v)),
        f"""SELECT {SUMS} FROM visits WHERE waktu_registrasi >=
            (SELECT max(waktu_registrasi) FROM visits) - INTERVAL '1 day'""",
    )
    on_visits(
        "Q-31_district", lambda v: both(revenue.last_day(v, district=DISTRICT)),
        f"""SELECT {SUMS} FROM visits WHERE kabupaten = '{DISTRICT}' AND waktu_registrasi >=
            (SELECT max(waktu_registrasi) FROM visits) - INTERVAL '1 day'""",
    )
    for tag, kw, _, cond in [("", {}, "", LATEST_MONTH), *SETS]:
        on_visits(
            f"Q-32{tag}", lambda v, kw=kw: rounded(revenue.total_revenue(v, **kw), "total", digits=2),
            f"SELECT round(sum(total_tagihan), 2) AS total FROM visits WHERE {cond}",
        )
        on_visits(
            f"Q-33{tag}", lambda v, kw=kw: rounded(revenue.total_cost(v, **kw), "total", digits=2),
            f"SELECT round(sum(total_semua_hpp), 2) AS total FROM visits WHERE {cond}",
        )
        on_visits(
            f"Q-45{tag}", lambda v, kw=kw: rounded(revenue.profit(v, **kw), "profit", digits=2),
            f"SELECT round(sum(total_tagihan) - sum(total_semua_hpp), 2) AS profit FROM visits WHERE {cond}",
        )
        on_visits(
            f"Q-tiles{tag}",
            lambda v, kw=kw: rounded(revenue.tiles(v, **kw), "pendapatan", "pengeluaran", "profit", digits=2),
            f"""SELECT round(sum(total_tagihan), 2) AS pendapatan, round(sum(total_semua_hpp), 2) AS pengeluaran,
                round(sum(total_tagihan) - sum(total_semua_hpp), 2) AS profit,
                count(DISTINCT id_pasien) AS pasien,
                count(DISTINCT id_pasien) FILTER (WHERE fix_pasien_baru = 't') AS pasien_baru,
                count(DISTINCT id_pasien) FILTER (WHERE fix_pasien_baru = 'f') AS pasien_lama
                FROM visits WHERE {cond}""",
        )


def register_rest() -> None:
    for tag, kw, _, cond in ALL[:3]:
        on_visits(
            f"Q-48{tag}", lambda v, kw=kw: geography.per_district(v, **kw),
            f"SELECT kabupaten, count(kabupaten) AS count FROM visits WHERE {cond} GROUP BY 1",
        )
    on_visits(
        "Q-48_province", lambda v: geography.per_district(v, province="ASIA", year=2000),
        f"""SELECT kabupaten, count(kabupaten) AS count FROM visits
            WHERE provinsi = 'ASIA' AND {IN_YEAR} GROUP BY 1""",
    )
    asia = ["NATION_12", "NATION_17", "NATION_2", "NATION_22", "NATION_7"]
    filled = ", ".join(f'coalesce("{n}", 0) AS "{n}"' for n in asia)
    on_visits(
        "Q-49", lambda v: geography.per_district_daily(v, year=2000, province="ASIA"),
        f"""WITH g AS (SELECT date_trunc('day', waktu_registrasi) AS d, {counts(asia, 'kabupaten', True)}
                       FROM visits WHERE provinsi = 'ASIA' AND {IN_YEAR} GROUP BY 1),
              spine AS (SELECT unnest(generate_series((SELECT min(d) FROM g), (SELECT max(d) FROM g),
                        INTERVAL 1 DAY)) AS day)
            SELECT strftime(day, '%Y-%m-%d') AS time_period, {filled}
            FROM spine LEFT JOIN g ON day = d""",
    )
    on_visits(
        "Q-50", utility.last_update,
        """SELECT strftime(max(waktu_registrasi), '%Y-%m-%d %H:%M:%S') AS waktu_registrasi_terakhir
           FROM visits""",
    )
    on_visits(
        "Q-51", utility.filter_options,
        """SELECT DISTINCT 'kabupaten' AS option, kabupaten AS value FROM visits UNION ALL
           SELECT 'tahun', CAST(y AS VARCHAR) FROM (SELECT unnest(generate_series(
             year(min(waktu_registrasi)), year(max(waktu_registrasi)))) AS y FROM visits) UNION ALL
           SELECT 'bulan', CAST(m AS VARCHAR) FROM (SELECT unnest(generate_series(1, 12)) AS m)""",
    )
    on_visits(
        "Q-51_observed", lambda v: utility.filter_options(v, observed=True),
        """SELECT DISTINCT 'kabupaten' AS option, kabupaten AS value FROM visits UNION ALL
           SELECT DISTINCT 'tahun', CAST(year(waktu_registrasi) AS VARCHAR) FROM visits UNION ALL
           SELECT DISTINCT 'bulan', CAST(month(waktu_registrasi) AS VARCHAR) FROM visits""",
    )


def register_rolled() -> None:
    """The queries that roll-ups answer, beside the SQL of the plain ones."""

    def money(query, *columns, digits=4, **given):
        return lambda v, **kw: rounded(query(v, **given, **kw), *columns, digits=digits)

    kinds = {
        "Q-1": rolled.growth,
        "Q-19": rolled.patients_by_gender,
        "Q-20": lambda v, **kw: rolled.patients_by_gender_over_time(v, values=_labels(v, "jenis_kelamin", kw), **kw),
        "Q-22": rolled.unique_patients,
        "Q-25": rolled.patients_by_age,
        "Q-26": money(rolled.revenue_by_registration_type, *TYPES, digits=2, values=TYPES),
        "Q-46": money(rolled.revenue_over_time, "total_tagihan", "total_semua_hpp"),
    }
    for base, query in kinds.items():
        for tag, kw in [("", {}), *((t, k) for t, k, _, _ in SETS)]:
            plain = ORACLES[f"{base}{tag}"]
            add(f"{base}_rolled{tag}", lambda spark, sf_dir, query=query, kw=kw: query(visits(spark, sf_dir), **kw), plain)
    add("Q-23_rolled", lambda spark, sf_dir: rolled.new_per_year(visits(spark, sf_dir)), ORACLES["Q-23"])


def register() -> None:
    register_visits()
    register_patients()
    register_revenue()
    register_rest()
    register_rolled()
