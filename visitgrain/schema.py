"""The visits fact table: schema, label domains and preset cubes."""

from __future__ import annotations

from pyspark.sql import types as T

# Names and types of the visits columns.
VISIT_SCHEMA = T.StructType(
    [
        T.StructField("id_registrasi", T.LongType()),
        T.StructField("id_pasien", T.LongType()),
        T.StructField("jenis_kelamin", T.StringType()),
        T.StructField("ttl", T.LongType()),
        T.StructField("provinsi", T.StringType()),
        T.StructField("kabupaten", T.StringType()),
        T.StructField("rujukan", T.StringType()),
        T.StructField("no_registrasi", T.LongType()),
        T.StructField("jenis_registrasi", T.StringType()),
        T.StructField("fix_pasien_baru", T.StringType()),
        T.StructField("nama_departemen", T.StringType()),
        T.StructField("jenis_penjamin", T.StringType()),
        T.StructField("diagnosa_primer", T.StringType()),
        T.StructField("nama_instansi_utama", T.StringType()),
        T.StructField("waktu_registrasi", T.TimestampNTZType()),
        T.StructField("total_semua_hpp", T.DoubleType()),
        T.StructField("total_tagihan", T.DoubleType()),
        T.StructField("tanggal_lahir", T.DateType()),
        T.StructField("tglPulang", T.TimestampNTZType()),
        T.StructField("usia", T.DoubleType()),
        T.StructField("kategori_usia", T.StringType()),
        T.StructField("kelas_hak", T.StringType()),
        T.StructField("los_rawatan", T.DoubleType()),
        T.StructField("pekerjaan", T.StringType()),
    ]
)
COLUMNS = VISIT_SCHEMA.names

# The same 24 columns as text, for sources that are cast in a second step.
TEXT_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in COLUMNS])

EVENT_TIME = "waktu_registrasi"
REVENUE = "total_tagihan"
COST = "total_semua_hpp"
PATIENT = "id_pasien"
VISIT_KEY = "id_registrasi"

# Partition columns of the stored fact table, both derived from EVENT_TIME.
PARTITION_YEAR = "visit_year"
PARTITION_MONTH = "visit_month"
PARTITIONS = (PARTITION_YEAR, PARTITION_MONTH)
STORED_SCHEMA = T.StructType(
    VISIT_SCHEMA.fields + [T.StructField(p, T.IntegerType()) for p in PARTITIONS]
)

# Labels the dashboards compare against or write.
OUTPATIENT = "Rawat Jalan"
INPATIENT = "Rawat Inap"
EMERGENCY = "IGD"
OVER_THE_COUNTER = "OTC"
REGISTRATION_TYPES = [EMERGENCY, OVER_THE_COUNTER, INPATIENT, OUTPATIENT]
UNKNOWN_DISTRICT = "Tidak Diketahui"
AMBIGUOUS_GENDER = "Ambigu"
NEW_PATIENT_LABELS = {"t": "Pasien Baru", "f": "Pasien Lama"}
HOME_PROVINCE = "RIAU"

# Spelling corrections applied while cleaning.
DISTRICT_ALIASES = {
    "KABUPATEN S I A K": "KABUPATEN SIAK",
    "KOTA B A T A M": "KOTA BATAM",
    "KOTA D U M A I": "KOTA DUMAI",
}
REFERRAL_ALIASES = {"Dalam": "Dalam RS", "Luar": "Luar RS"}
GENDER_ALIASES = {"perempuan": "Perempuan", "laki-laki": "Laki-laki"}

# Preset cubes, as keyword arguments for operators.cube.cube().
PRESET_CUBES = {
    "demografi": {"cats": ["kabupaten"], "measures": [], "where": {"provinsi": HOME_PROVINCE}},
    "jenisregis": {"cats": ["jenis_registrasi"], "measures": []},
    "pendapatan": {"cats": [], "measures": [REVENUE, COST]},
    "pendapatan/jenisregis": {"cats": ["jenis_registrasi"], "measures": [REVENUE]},
    "kunjungan/jenisregis": {"cats": ["jenis_registrasi"], "measures": []},
}
