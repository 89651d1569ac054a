"""Readers and sinks: user shapes, quoting, flags, missing tables, JDBC options."""

from decimal import Decimal

import pytest

from tests import seed
from tianguis.schema import TABLES
from tianguis.sources import sinks, tables


def test_csv_user_shape_without_id_drops_the_password(spark, tmp_path):
    (tmp_path / "usuarios.csv").write_text(
        "nombre,email,password,rol,estado,cupo_total,cupo_disponible,cupo_usado,veces_cupo_completo,compras_completadas\n"
        "Ana,ana@example.com,secret,comprador,activo,1000.50,900.00,100.50,0,2\n"
        'Luis,luis@example.com,secret,vendedor,pendiente,NULL,x,0,1,0\n')
    df = tables.read_table(spark, str(tmp_path), "usuarios", "csv")
    assert "password" not in df.columns and df.schema == TABLES["usuarios"]
    ana, luis = df.orderBy("nombre").collect()
    assert ana.id is None and ana.cupo_total == Decimal("1000.50") and ana.compras_completadas == 2
    assert luis.cupo_total is None and luis.cupo_disponible is None


def test_missing_table_is_empty_or_raises(spark, tmp_path):
    assert tables.read_table(spark, str(tmp_path), "pagos").schema == TABLES["pagos"]
    assert tables.read_table(spark, str(tmp_path), "pagos", "csv").isEmpty()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_table(spark, str(tmp_path), "pagos", optional=False).count()


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_export_round_trip(spark, tmp_path, fmt):
    t = seed.frames(spark)
    sinks.export_tables(t, str(tmp_path), fmt)
    back = tables.read_all(spark, str(tmp_path), fmt)
    for name, df in t.items():
        assert sorted(map(repr, back[name].collect())) == sorted(map(repr, df.collect())), name


def test_export_by_month(spark, tmp_path):
    t = seed.frames(spark)
    path = sinks.export_table(t["ordenes"], str(tmp_path), "ordenes", by_month=True)
    assert spark.read.parquet(path).filter("mes = '2026-04'").count() == 7
    assert (tmp_path / "ordenes.parquet" / "mes=2026-04").is_dir()


def test_flags_as_numbers_and_text(spark):
    df = spark.createDataFrame([(1, 1, "0"), (2, 0, "true")], "id int, activo int, aprobado string")
    got = tables.conform(df, TABLES["productos"]).orderBy("id").collect()
    assert [(r.activo, r.aprobado) for r in got] == [(True, False), (False, True)]


def test_jdbc_options():
    plain = tables.jdbc_options("jdbc:x", "productos", {"user": "u"})
    assert plain["dbtable"] == "productos" and "numPartitions" not in plain
    ranged = tables.jdbc_options("jdbc:x", "productos", {}, "id", (1, 1000), 8)
    assert (ranged["partitionColumn"], ranged["lowerBound"], ranged["upperBound"], ranged["numPartitions"]) == ("id", "1", "1000", "8")
    with pytest.raises(ValueError):
        tables.jdbc_options("jdbc:x", "productos", {}, "id")


def test_csv_keeps_texts_and_large_keys(spark, tmp_path):
    """Newlines, quotes, commas, a text that reads NULL, and keys beyond 2^31 come back as they went."""
    texts = ["two\nlines", 'a "quoted" word', "one, two", "NULL", "\\N?", None, "plain"]
    rows = [(3_000_000_000 + i, None, f"p{i}", t, None, 1, True, True, None) for i, t in enumerate(texts)]
    sinks.export_table(spark.createDataFrame(rows, TABLES["productos"]), str(tmp_path), "productos", "csv", null="\\N")
    good, refused = tables.read_checked(spark, str(tmp_path), "productos", null="\\N")
    assert sorted((r.id, r.descripcion) for r in good.collect()) == [(3_000_000_000 + i, t) for i, t in enumerate(texts)]
    assert refused.count() == 0


def test_rows_that_do_not_type_are_set_aside(spark, tmp_path):
    (tmp_path / "ordenes.csv").write_text(
        "id,id_comprador,total,estado,fecha\n1,7,10.50,pagada,2024-01-01\nx,7,1.00,pagada,2024-01-01\n3,7,123456789.50,pagada,soon\n4,NULL,NULL,pagada,NULL\n"
    )
    good, refused = tables.read_checked(spark, str(tmp_path), "ordenes")
    assert sorted(r.id for r in good.collect()) == [1, 4]
    assert sorted((r.id, tuple(r.columnas)) for r in refused.collect()) == [("3", ("total", "fecha")), ("x", ("id",))]
