import pytest
from conftest import column

from bookpulse.plans.client_book import ClientBook
from bookpulse.session import work_folder
from bookpulse.sources import tables


def test_csv_and_parquet_read_alike(raw, spark, tmp_path):
    df = raw({}, {"balance_owner_name": 'a "quoted", name', "balance_paid": "N/A", "minimum_spread": None})
    df.write.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    df.write.parquet(str(tmp_path / "parquet"))
    a = tables.read_transactions(spark, str(tmp_path / "csv"), "csv")
    b = tables.read_transactions(spark, str(tmp_path / "parquet"))
    assert a.schema.simpleString() == b.schema.simpleString()
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_typed_columns_are_accepted(spark, tmp_path):
    path = str(tmp_path / "typed")
    spark.sql(
        "SELECT 'c' balance_owner_uuid, 'n' balance_owner_name, 'b' intermediary_uuid, 'B' intermediary_name, "
        "timestamp'2025-01-01 10:00:00' trigger_at, 'COMPLETED' status, 12.5D balance_paid, 100000000L er_paid_to_usd, "
        "5 profit_spread_bps, 1 minimum_spread, 'x' other").write.parquet(path)
    row = tables.read_transactions(spark, path).first()
    assert (row["trigger_at"], row["balance_paid"], row["er_paid_to_usd"], row["other"]) == (
        "2025-01-01 10:00:00", "12.5", 1e8, "x")


def test_missing_tables_read_as_empty(spark, tmp_path):
    scores = tables.read_scores_or_empty(spark, str(tmp_path / "none"))
    assert scores.columns == ["client_id", "churn_probability", "churn_score", "risk_label"] and scores.count() == 0


def test_get_or_build_builds_once(spark, tmp_path):
    calls = []

    def builder():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.get_or_build(spark, str(tmp_path / "t"), builder).count() == 3
    assert calls == [1]


def test_unfinished_table_is_built_again(spark, tmp_path):
    path = tmp_path / "t"
    tables.write_table(spark.range(2), str(path))
    (path / "_SUCCESS").unlink()
    assert tables.get_or_build(spark, str(path), lambda: spark.range(5)).count() == 5


def test_work_folder_follows_the_cluster_setting(spark):
    assert work_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.fixture(scope="module")
def whole_book(spark, tmp_path_factory):
    from checks.book import raw_transactions

    raw = tables.type_raw(raw_transactions(spark, "/root/testdata/sf0.001"))
    return ClientBook(spark, str(tmp_path_factory.mktemp("book")), raw, rounds=2)


def test_book_properties(whole_book):
    book = whole_book
    clients = book.features.count()
    assert clients == 30
    assert sum(column(book.features.groupBy("segment").count(), "count")) == clients
    per_client = book.opportunities.groupBy("client_id").count()
    assert max(column(per_client, "count")) <= 2
    assert book.features.where("R NOT BETWEEN 1 AND 4 OR F NOT BETWEEN 1 AND 4 OR M NOT BETWEEN 1 AND 4").count() == 0
    assert book.churn_scores.count() == clients
    report = {(r["section"], r["key"]): r["value"] for r in book.churn_report.collect()}
    assert sum(v for (s, _), v in report.items() if s == "risk") == clients
    assert 0 <= report["metrics", "roc_auc"] <= 1
    for name, df in book.reports().items():
        assert df.count() > 0, name


def test_book_messages_for_one_broker_then_all(whole_book):
    first = whole_book.opportunities.agg({"broker_id": "min"}).first()[0]
    stored = whole_book.write_messages(first)
    assert set(column(stored, "broker_id")) == {first}
    assert whole_book.write_messages().count() == whole_book.opportunities.count()


def test_command_line_steps(spark, tmp_path, raw, capsys):
    from bookpulse.__main__ import main

    rows = [
        {"balance_owner_uuid": f"client-{c:04d}", "trigger_at": f"2025-06-{d:02d} 10:00:00+00", "balance_paid": str(10 * c + d)}
        for c in range(1, 6) for d in (1, 9, 20, 30)
    ]
    raw(*rows).write.parquet(str(tmp_path / "raw"))
    folder = str(tmp_path / "book")
    main(["profile", "--input", str(tmp_path / "raw"), "--folder", folder])
    main(["features", "--folder", folder])
    main(["opportunities", "--folder", folder])
    main(["messages", "--folder", folder, "--company", "Cambio Uno", "--json", str(tmp_path / "json")])
    main(["reports", "--folder", folder])
    shown = capsys.readouterr().out
    assert "row_count" in shown and "client-0003" in shown
    exported = spark.read.json(str(tmp_path / "json"))
    assert exported.count() == spark.read.parquet(f"{folder}/opportunities").count() > 0
    assert spark.read.parquet(f"{folder}/reports/activity_grid").count() == 168


@pytest.fixture
def clients(raw):
    """clients(n): one raw row for each of n clients."""
    return lambda n, **more: raw(*[{"balance_owner_uuid": f"client-{c:04d}"} | more for c in range(n)])


class Builds:
    """Names of the tables that are written, in order, and the raw tables that are scanned."""

    def __init__(self, monkeypatch):
        from bookpulse.sources import lineage

        self.names, self.digests = [], 0
        write, save, digest = tables.write_table, tables.save_model, lineage.table_digest

        def counted(*args):
            self.digests += 1
            return digest(*args)

        monkeypatch.setattr(tables, "write_table", lambda df, path: (self.names.append(path.split("/")[-1]), write(df, path))[1])
        monkeypatch.setattr(tables, "save_model", lambda m, path: (self.names.append(path.split("/")[-1]), save(m, path))[1])
        monkeypatch.setattr(lineage, "table_digest", counted)

    def taken(self):
        found, self.names = self.names, []
        return found


def test_new_input_replaces_the_book(spark, tmp_path, clients, monkeypatch):
    builds, folder = Builds(monkeypatch), str(tmp_path / "book")
    assert ClientBook(spark, folder, clients(5)).features.count() == 5
    assert builds.taken() == ["transactions", "reference_date", "features"] and builds.digests == 0
    # Other rows give another book, without being asked for one.
    assert ClientBook(spark, folder, clients(50)).features.count() == 50
    assert builds.taken() == ["transactions", "reference_date", "features"] and builds.digests == 1
    # The same rows, in other partitions and order, are digested once and nothing is built.
    again = ClientBook(spark, folder, clients(50).repartition(7).orderBy("balance_owner_uuid", ascending=False))
    assert again.features.count() == 50 and again.opportunities.count() > 0
    assert builds.taken() == ["opportunities"] and builds.digests == 2
    assert again.features.count() == 50 and builds.digests == 2
    # Without raw rows the stored ones stand; one row more is another input.
    assert ClientBook(spark, folder).features.count() == 50 and builds.taken() == []
    more = clients(50).unionByName(clients(1))
    assert ClientBook(spark, folder, more).features.where("tx_count_total = 2").count() == 1
    assert ClientBook(spark, folder, more, replace=True).features.count() == 50
    assert builds.taken().count("features") == 2


def test_settings_rebuild_what_follows_from_them(spark, tmp_path, raw, monkeypatch):
    rows = [
        {"balance_owner_uuid": f"client-{c:04d}", "trigger_at": f"2025-{m:02d}-{1 + c % 20:02d} 10:00:00+00", "balance_paid": str(c + m)}
        for c in range(40) for m in ((1, 2, 6) if c % 2 else (1, 2))
    ]
    builds, folder = Builds(monkeypatch), str(tmp_path / "book")
    first = ClientBook(spark, folder, raw(*rows), rounds=1)
    assert first.churn_scores.count() == 40
    assert {"features", "churn_training", "churn_model", "churn_scores"} <= set(builds.taken())
    assert ClientBook(spark, folder, raw(*rows), rounds=1).churn_scores.count() == 40 and builds.taken() == []
    other = ClientBook(spark, folder, raw(*rows), rounds=2)
    assert other.churn_scores.count() == 40 and builds.taken() == ["churn_model", "churn_scores"]
    assert len(other.model.trees) == 2
    with_id = ClientBook(spark, folder, raw(*rows).selectExpr("*", "1 AS tx_id"), rounds=2, extra_columns=("tx_id",))
    assert "tx_id" in with_id.transactions.columns and builds.taken() == ["transactions"]


def test_interrupted_build_is_repeated(spark, tmp_path, clients, monkeypatch):
    folder = str(tmp_path / "book")
    assert ClientBook(spark, folder, clients(3)).features.count() == 3
    (tmp_path / "book" / "features" / "_recipe.json").unlink()  # written last
    builds = Builds(monkeypatch)
    assert ClientBook(spark, folder, clients(3)).features.count() == 3
    assert builds.taken() == ["features"]
    with pytest.raises(ValueError):
        _ = ClientBook(spark, str(tmp_path / "none")).features


def test_digest_of_a_table(spark):
    from bookpulse.sources.lineage import table_digest

    schema = "a string, b string, c double, d long"
    base = [("x", None, 1.0, 1), (None, "x", 1.0, 1), ("x", "x", None, None), ("x", None, 1.0, 1)]

    def digest(rows, parts=1, columns=("a", "b", "c", "d")):
        return table_digest(spark.createDataFrame(rows, schema).repartition(parts), columns)

    whole = digest(base)
    assert digest(base[::-1], 3) == whole
    different = [
        base[:3], base + base[:1], [("x", None, 1.0, 1)] * 3 + base[2:3], [(None, "x", 1.0, 1), *base[1:]],
        [("x", None, 1.0, 2), *base[1:]], [], [(None, None, None, None)], [(None, None, None, None)] * 2,
    ]
    assert len({whole, *map(digest, different)}) == 1 + len(different)
    assert digest(base, columns=("a", "b")) != digest(base, columns=("b", "a"))


def test_csv_field_with_a_line_break(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(
        "balance_owner_uuid,balance_owner_name,intermediary_uuid,intermediary_name,trigger_at,status,balance_paid,"
        'er_paid_to_usd,profit_spread_bps,minimum_spread\nC1,"Ana\nMaria",B1,Broker,2025-06-30 12:00:00+00,COMPLETED,5,1e8,1,1\n'
    )
    rows = tables.read_transactions(spark, str(tmp_path / "raw.csv"), "csv").collect()
    assert [r["balance_owner_name"] for r in rows] == ["Ana\nMaria"]
