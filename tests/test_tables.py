"""Keyed tables: what changes, what is refused, and what a writer that dies leaves."""

import pytest

from millrace.sources.tables import Conflict, KeyedTable, import_catalogue

SCHEMA = "id long, name string, n int"


def rows(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["id"], 4)
    t.insert(spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", None)], SCHEMA))
    return t


def test_changes(spark, table):
    new = lambda data, ddl=SCHEMA: spark.createDataFrame(data, ddl)
    assert table.upsert(new([(2, None, 20), (9, "z", None)])) == 2
    assert rows(table) == [(1, "a", 1), (2, "b", 20), (3, "c", None), (9, "z", None)]
    assert table.upsert(new([(7, 70)], "id long, n int")) == 3 and rows(table)[3] == (7, None, 70)
    assert table.update(new([(1, None, None)]), clear=("n",)) == 4 and rows(table)[0] == (1, "a", None)
    assert table.delete(new([(1,), (99,), (1,)], "id long")) == 5 and [r[0] for r in rows(table)] == [2, 3, 7, 9]
    assert rows(table, 1) == [(1, "a", 1), (2, "b", 2), (3, "c", None)]  # as of an earlier commit
    assert table.insert(new([])) == 5
    assert KeyedTable(spark, table.folder, SCHEMA, ["id"], 4).read().count() == 4
    table.delete(table.read())
    assert rows(table) == []


def test_what_is_refused_changes_nothing(spark, table):
    new = lambda data, ddl=SCHEMA: spark.createDataFrame(data, ddl)
    before = rows(table)
    for change, message in (
        (lambda: table.insert(new([(5, "x", 1), (2, "y", 1)])), "key exists"), (lambda: table.update(new([(8, "x", 1)])), "no such key"), (lambda: table.upsert(new([(5, "x", 1), (5, "y", 1)])), "repeated key"),
        (lambda: table.insert(new([(None, "x", 1)])), "null in the key"), (lambda: table.upsert(new([(5, 1)], "id long, other int")), "unknown columns"), (lambda: table.insert(new([(5,)], "id long")), "missing columns"),
    ):
        with pytest.raises(ValueError, match=message):
            change()
        assert rows(table) == before and table.version() == 1


def test_a_writer_that_dies_leaves_the_old_state(spark, table, monkeypatch):
    before = rows(table)

    def dies(version, places):
        raise RuntimeError("lost")

    monkeypatch.setattr(table, "commit", dies)
    with pytest.raises(RuntimeError):
        table.upsert(spark.createDataFrame([(1, "changed", 5)], SCHEMA))
    monkeypatch.undo()
    assert rows(table) == before and table.version() == 1
    assert table.upsert(spark.createDataFrame([(1, "changed", 5)], SCHEMA)) == 2 and rows(table)[0] == (1, "changed", 5)


def test_one_of_two_writers_wins(spark, table):
    version = table.version()
    table.upsert(spark.createDataFrame([(1, "first", 5)], SCHEMA))
    with pytest.raises(Conflict):
        table.commit(version, {})
    assert rows(table)[0] == (1, "first", 5)


def test_untouched_buckets_stay(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "id long", ["id"], 8)
    t.insert(spark.range(100))
    before = t.places()
    t.upsert(spark.range(200, 201))
    assert sum(before[b] != p for b, p in t.places().items()) == 1 and t.read().count() == 101


def test_catalogues(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "id string, brand string, model string, price double", ["id"])
    headers = {"Brand": "brand", "Model": "model", "Price": "price"}
    (tmp_path / "a.csv").write_text('brand,Model,PRICE\nAcme,"Big, ""one""",10\nacme,  big,  x\nAcme,Big,12\n,none,1\n"Multi\nline",m,\n')
    assert import_catalogue(t, str(tmp_path / "a.csv"), headers, ("brand", "model")) == {"refused": 1, "created": 3, "changed": 0}
    assert sorted((r.brand, r.model, r.price) for r in t.read().collect()) == [("Acme", "Big", 12.0), ("Acme", 'Big, "one"', 10.0), ("Multi\nline", "m", None)]
    (tmp_path / "b.csv").write_text("Model;Brand\nbig;ACME\nnew;Acme\n")
    assert import_catalogue(t, str(tmp_path / "b.csv"), headers, ("brand", "model"), ";") == {"refused": 0, "created": 1, "changed": 1}
    assert sorted((r.brand, r.model, r.price) for r in t.read().where("price = 12").collect()) == [("ACME", "big", 12.0)]
    (tmp_path / "c.csv").write_text("Model,Colour\nbig,red\n")
    with pytest.raises(ValueError, match="unknown columns"):
        import_catalogue(t, str(tmp_path / "c.csv"), headers, ("brand", "model"))
