import glob
import os

import pytest
from pyspark.sql import functions as F

from claimspark import CodeLists, CostDrivers, Sources, StudyWindow
from claimspark.sources import store
from claimspark.sources.text_tables import REQUIRED_COLUMNS, read_text_csv
from harness.tables import disenrolled, source_tables
from tests.conftest import SF_TINY, person, values


class Session:
    """A session with the settings of a test."""

    def __init__(self, folder=None, checkpoint=None):
        self.conf = self
        self.sparkContext = self
        self.folder, self.checkpoint = folder, checkpoint

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" and self.folder else default

    def getCheckpointDir(self):
        return self.checkpoint


def test_shared_folder_comes_from_the_session():
    assert store.shared_folder(Session("hdfs://shared/checkpoints/")) == "hdfs://shared/checkpoints"
    assert store.shared_folder(Session(checkpoint="s3a://b/c")) == "s3a://b/c"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_folder(Session())


def test_tables_are_written_once(spark, tmp_path):
    built = []
    tables = store.TableStore(str(tmp_path))

    def build():
        built.append(1)
        return spark.createDataFrame([(1, "a", True)], "n int, src string, flag boolean")

    first, second = tables.table("t", build, ["src"]), tables.table("t", build, ["src"])
    assert built == [1]
    assert first.columns == ["n", "src", "flag"]
    assert values(first) == values(second) == [(1, "a", True)]
    assert glob.glob(f"{tmp_path}/t-*/src=a/*.parquet")


def test_tables_belong_to_their_inputs(spark, tmp_path):
    one, other = store.TableStore(str(tmp_path)), store.TableStore(str(tmp_path))

    def number(n):
        return lambda: spark.range(n, n + 1)

    first = one.table("t", number(1), inputs=["a", {}])
    assert values(one.table("t", number(2), inputs=["b", {}])) == [(2,)]
    assert values(other.table("t", number(3), inputs=["a", {}])) == [(3,)]
    assert values(first) == [(1,)]


def test_partitioned_writes_make_few_files(spark, tmp_path):
    df = spark.range(0, 4000, 1, 40).selectExpr("id", "id % 8 AS k")
    store.write_table(df, f"{tmp_path}/t", ["k"])
    assert len(glob.glob(f"{tmp_path}/t/k=*/*.parquet")) <= 16


def test_dynamic_overwrite_replaces_single_partitions(spark, tmp_path):
    schema = "yr int, n int"
    store.write_table(spark.createDataFrame([(2016, 1), (2017, 2)], schema), f"{tmp_path}/t", ["yr"])
    table = store.write_table(spark.createDataFrame([(2017, 5)], schema), f"{tmp_path}/t", ["yr"], dynamic=True)
    assert values(table) == [(2016, 1), (2017, 5)]
    table = store.write_table(spark.createDataFrame([(2018, 9)], schema), f"{tmp_path}/t", ["yr"])
    assert values(table) == [(2018, 9)]


def test_csv_export_is_one_sorted_file(spark, tmp_path):
    rows = [(2, "b", 1205848778.0, None), (1, "a, b", 0.1, "x"), (1, "A", None, "")]
    df = spark.createDataFrame(rows, "yr int, name string, v double, note string").repartition(3)
    store.export_csv(df, f"{tmp_path}/out", ["yr", "name"])
    (part,) = glob.glob(f"{tmp_path}/out/*.csv")
    assert open(part).read().splitlines() == [
        "yr,name,v,note",
        '1,A,,""',
        '1,"a, b",0.1,x',
        "2,b,1205848778.0,",
    ]


def test_numbers_of_an_export_are_plain(spark, tmp_path):
    numbers = [11140748.0, 0.1, -2.5e-7, 1e22, 123456.789, float("nan"), None, -0.5, 5e-324, 100.0]
    df = spark.createDataFrame(list(enumerate(numbers)), "k int, v double").withColumn("d", F.lit("7.2500").cast("decimal(9,4)"))
    store.export_csv(df, f"{tmp_path}/out", ["k"])
    (part,) = glob.glob(f"{tmp_path}/out/*.csv")
    cells = [line.split(",") for line in open(part).read().splitlines()[1:]]
    assert [c[1] for c in cells][:6] == ["11140748.0", "0.1", "-0.00000025", "10000000000000000000000.0", "123456.789", "NaN"]
    assert [float(c[1]) for c in cells if c[1] not in ("", "NaN")] == [n for n in numbers if n is not None and n == n]
    assert {c[2] for c in cells} == {"7.25"}


def test_row_tables_are_not_exported_as_one_file(spark, tmp_path):
    store.export_csv(spark.range(100), f"{tmp_path}/fits", ["id"], most_rows=100)
    with pytest.raises(Exception, match="too many for a single file"):
        store.export_csv(spark.range(101), f"{tmp_path}/out", ["id"], most_rows=100)


def test_csv_cells(spark, tmp_path):
    columns = REQUIRED_COLUMNS["pde"]
    header = ["EXTRA", *reversed(columns)]
    cells = {"BENE_ID": "007", "PDE_ID": "1", "SRVC_DT": "", "PROD_SRVC_ID": '""', "TOT_RX_CST_AMT": " "}
    lines = ["|".join(header), "|".join(cells.get(c, "") for c in header)]
    (tmp_path / "pde.csv").write_text("\n".join(lines) + "\n")
    row = read_text_csv(spark, f"{tmp_path}/pde.csv", "pde", sep="|").first()
    # Matched by name, nothing typed, empty and quoted empty are NULL, a blank stays.
    assert row.asDict() == dict.fromkeys(columns) | {"BENE_ID": "007", "PDE_ID": "1", "TOT_RX_CST_AMT": " "}


@pytest.fixture
def csv_folder(tmp_path):
    claim = {"BENE_ID": "a", "CLM_ID": "1", "CLM_FAC_TYPE_CD": "1", "CLM_SRVC_CLSFCTN_TYPE_CD": "1"}
    rows = {
        "beneficiary": [person("a"), person("a", 2017)],
        "inpatient": [
            claim | {"CLM_FROM_DT": "03-Feb-2016", "CLM_PMT_AMT": "600"},
            claim | {"CLM_ID": "2", "CLM_FROM_DT": "03-Feb-2017", "CLM_PMT_AMT": "1200"},
        ],
        "pde": [{"BENE_ID": "a", "PDE_ID": "3", "SRVC_DT": "01-Jan-2016", "TOT_RX_CST_AMT": "24"}],
    }
    for name, columns in REQUIRED_COLUMNS.items():
        lines = [columns, *([row.get(c) or "" for c in columns] for row in rows.get(name, []))]
        (tmp_path / f"{name}.csv").write_text("\n".join(",".join(line) for line in lines) + "\n")
    return str(tmp_path)


def test_from_csv_files_to_growth(spark, csv_folder, tmp_path):
    """The whole analysis from text files, with a store of its own and with the session's folder."""
    expected = [
        (2016, "Inpatient Hospital", 50.0, None, None, None),
        (2016, "Retail Pharmacy", 2.0, None, None, None),
        (2017, "Inpatient Hospital", 100.0, 100.0, 50.0, 100.0),
    ]
    for kept in (None, store.TableStore(f"{tmp_path}/store")):
        cd = CostDrivers(Sources.from_csv(spark, csv_folder), CodeLists.builtin(spark), store=kept)
        assert values(cd.pmpm_growth()) == expected
        assert {r[4] for r in values(cd.checks()["row_counts"]())} == {"PASS"}


def test_sources_know_their_tables(spark):
    with pytest.raises(ValueError, match="claims"):
        Sources({"claims": spark.range(1)})


def test_from_parquet_files(spark, csv_folder, tmp_path):
    for name in REQUIRED_COLUMNS:
        read_text_csv(spark, f"{csv_folder}/{name}.csv", name).write.parquet(f"{tmp_path}/parquet/{name}")
    one, other = Sources.from_csv(spark, csv_folder), Sources.from_parquet(spark, f"{tmp_path}/parquet")
    for name in REQUIRED_COLUMNS:
        assert values(one[name]) == values(other[name])
    typed = spark.range(1).selectExpr(*[f"id AS {c}" for c in REQUIRED_COLUMNS["pde"]])
    typed.write.parquet(f"{tmp_path}/typed/pde")
    with pytest.raises(ValueError, match="must be all text"):
        Sources.from_parquet(spark, f"{tmp_path}/typed")["pde"]


def test_a_file_with_other_columns_fails(spark, tmp_path):
    columns = REQUIRED_COLUMNS["pde"]
    (tmp_path / "pde.csv").mkdir()
    for name, header in (("a", columns), ("b", columns[::-1])):
        (tmp_path / "pde.csv" / f"{name}.csv").write_text(f"{','.join(header)}\n{','.join(f'v_{c}' for c in header)}\n")
    table = read_text_csv(spark, f"{tmp_path}/pde.csv", "pde")
    for df in (table, table.select("BENE_ID")):
        with pytest.raises(Exception, match="(?i)header"):
            df.collect()


def test_two_windows_over_one_store(spark, csv_folder, tmp_path):
    shared = store.TableStore(f"{tmp_path}/store")
    sources, lists = Sources.from_csv(spark, csv_folder), CodeLists.builtin(spark)
    wide = CostDrivers(sources, lists, StudyWindow(), store=shared)
    narrow = CostDrivers(sources, lists, StudyWindow(2017, 2017, 2017), store=shared)
    alone = CostDrivers(sources, lists, StudyWindow(2017, 2017, 2017), store=store.TableStore(f"{tmp_path}/alone"))
    assert {r[0] for r in values(wide.mm_fact())} == {2016, 2017}
    for name in ("mm_fact", "spend_fact", "members_fact", "pmpm_growth", "validation"):
        assert values(getattr(narrow, name)()) == values(getattr(alone, name)())


def test_two_code_lists_over_one_store(spark, csv_folder, tmp_path):
    shared = store.TableStore(f"{tmp_path}/store")
    sources = Sources.from_csv(spark, csv_folder)
    full = CodeLists.builtin(spark)
    none = CodeLists(full.service_codes.limit(0), full.places, full.specialties)
    paths = []
    for lists in (full, none):
        cd = CostDrivers(sources, lists, store=shared)
        paths.append(cd.pc_step5().inputFiles())
        assert cd.spend().inputFiles() == CostDrivers(sources, full, store=shared).spend().inputFiles()
    assert not set(paths[0]) & set(paths[1])


def test_changed_partitions_are_rebuilt_and_old_readers_go_on(spark, tmp_path):
    tables = store.TableStore(f"{tmp_path}")
    rows = lambda shift: spark.range(40).selectExpr("id % 4 AS yr", f"id + {shift} AS x", "if(id % 2 = 0, 'a', 'b') AS src")
    old = tables.table("t", lambda: rows(0), ["yr", "src"], ["one"])
    files = {p: os.path.getmtime(p) for p in glob.glob(f"{tmp_path}/t-*/**/*.parquet", recursive=True)}
    new = tables.rebuilt("t", old, lambda: rows(1000), {"yr": [1], "src": []}, ["yr", "src"], ["two"])
    assert values(new) == values(rows(0).where("yr <> 1").unionByName(rows(1000).where("yr = 1")))
    assert values(old) == values(rows(0)) and values(tables.table("t", None, inputs=["one"])) == values(old)
    assert values(tables.table("t", None, inputs=["two"])) == values(new)
    written = set(glob.glob(f"{tmp_path}/t-*/**/*.parquet", recursive=True)) - set(files)
    assert written and all("/yr=1/" in p for p in written) and all(os.path.getmtime(p) == t for p, t in files.items())
    third = tables.rebuilt("t", new, lambda: rows(5000), {"yr": [2], "src": ["b"]}, ["yr", "src"], ["three"])
    assert values(third) == values(new.where("yr <> 2 AND src <> 'b'").unionByName(rows(5000).where("yr = 2 OR src = 'b'")))
    assert tables.rebuilt("t", old, None, {}, ["yr"], ["four"]) is old
    with pytest.raises(ValueError, match="x"):
        tables.rebuilt("t", old, lambda: rows(1), {"x": [1]}, ["yr"], ["five"])


def test_rows_of_unknown_partitions_stay(spark, tmp_path):
    tables = store.TableStore(f"{tmp_path}")
    old = tables.table("t", lambda: spark.createDataFrame([(None, 1), (2019, 2)], "yr int, x int"), ["yr"], ["one"])
    new = tables.rebuilt("t", old, lambda: spark.createDataFrame([(2019, 3), (2020, 9)], "yr int, x int"), {"yr": [2019]}, ["yr"], ["two"])
    assert values(new, "x", "yr") == [(1, None), (3, 2019)]


def test_a_rebuilt_analysis_equals_a_new_one(spark, tmp_path):
    tables = store.TableStore(f"{tmp_path}/store")
    cd = CostDrivers(source_tables(spark, SF_TINY, tables), CodeLists.builtin(spark), store=tables)
    before = values(cd.spend_fact())
    changed = disenrolled(cd.sources)
    new = cd.rebuild(changed, years=[2019], files=["pde"])
    alone = CostDrivers(changed, cd.lists, store=store.TableStore(f"{tmp_path}/alone"))
    for name in ("member_months_by_year", "spend_fact", "members_fact", "pmpm_growth", "primary_care_by_year"):
        assert values(getattr(new, name)()) == values(getattr(alone, name)())
    part = lambda df: {p for p in df.inputFiles() if "yr=2018/src=carrier" in p}
    assert part(new.spend()) == part(cd.spend()) and part(cd.spend())
    assert values(cd.spend_fact()) == before != values(new.spend_fact())
    with pytest.raises(ValueError, match="claim files"):
        cd.rebuild(changed, files=["dental"])


def test_a_task_with_many_rows_does_not_send_them_to_one_task(spark, tmp_path, monkeypatch, with_conf):
    """Spark can't cut what one task sends to one partition, so it is sent in blocks; few rows go on in one."""
    with_conf({"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"})
    made = spark.range(0, 40_000, 1, 1).select("id", (F.col("id") % 2).alias("yr"))

    def most_in_a_task():
        df = store.gathered(made, ["yr"])
        assert df.columns == made.columns
        return max(n for (n,) in values(df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")), "n"))

    assert most_in_a_task() >= 20_000
    monkeypatch.setattr(store, "BLOCK_ROWS", 1000)
    assert most_in_a_task() < 10_000
    assert values(store.write_table(made, f"{tmp_path}/t", ["yr"])) == values(made)
