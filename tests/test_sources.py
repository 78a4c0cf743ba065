import datetime as dt

from autobi.sources import tables
from tests.helpers import rows


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_ragged_csv(spark, tmp_path):
    path = write(tmp_path / "r.csv", "a,b,c\n1,2,3\n1,2\n1,2,3,4\n")
    assert rows(tables.scan_csv(spark, path)) == [("1", "2", "3")]
    assert tables.scan_csv(spark, path, tolerant=True).count() == 3


def test_ingest_types_columns(spark, tmp_path):
    path = write(tmp_path / "s.csv", "data,vendas,região\n2024-01-01,\"1,000.5\",São Paulo\n2024-01-02,20,Brasília\n2024-01-03,30,João Pessoa\n")
    out = str(tmp_path / "t")
    assert rows(tables.ingest_csv(spark, path, out)) == [(out, 3)]
    back = spark.read.parquet(out)
    assert dict(back.dtypes) == {"data": "timestamp_ntz", "vendas": "double", "região": "string"}
    assert back.agg({"vendas": "sum"}).first()[0] == 1050.5


def test_expired(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 10)), (3, None)], "id int, used timestamp_ntz")
    assert rows(tables.expired(df, "used", "2024-01-11", 10).select("id")) == [(1,)]


def test_row_ids_rise(spark):
    ids = [r.row_id for r in tables.with_row_id(spark.range(5)).collect()]
    assert ids == sorted(set(ids))
