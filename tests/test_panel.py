"""Golden values of the panel operators on small frames."""

import datetime as dt
import os
import time

import numpy as np
import pytest

from panelspark.functions import dates, strings
from panelspark.operators import fill, merge, portfolio, regression, transform
from panelspark.plans import sql as sql_plan
from panelspark.sources import load, show

KEYS = [(10516, "a"), (10516, "b"), (10517, "a")]


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(p, b, f"1/{d}/2000", 1 + (4 * g + d) / 100) for g, (p, b) in enumerate(KEYS) for d in range(1, 5)]
    return spark.createDataFrame(rows, "PERMNO int, byvar string, Date string, RET double")


def values(df, column, n=4, order=("PERMNO", "byvar", "Date")):
    return [r[column] for r in df.orderBy(*order).collect()][:n]


def test_winsorize_clips_the_top_first(panel):
    assert values(transform.winsorize(panel, 0.4, "RET", ["PERMNO", "byvar"]), "RET") == pytest.approx([1.0216, 1.0216, 1.028, 1.028])


@pytest.mark.parametrize("method, time, want", [("between", [1, 3], [1.01, 1.02, 1.0506, 1.04]), ("between", [-2, 0], [1.01, 1.02, 1.0506, 1.04]), ("first", None, [1.01, 1.02, 1.0506, 1.092624])])
def test_cumulate(panel, method, time, want):
    assert values(transform.cumulate(panel, "RET", method, byvars=["PERMNO", "byvar"], time=time), "cum_RET") == pytest.approx(want)


def test_cumulate_without_groups_carries_over_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(float(d), None if d in (500, 501) else float(rng.uniform(0.99, 1.01))) for d in range(800)]
    df = spark.createDataFrame([*rows, (None, 1.5)], "d double, r double").repartition(3)
    for method, time, starts in (("between", [0, 3, 400], (0, 1, 4, 401)), ("first", None, (0, 1))):
        want, run = {}, None
        for k, (d, r) in enumerate([*rows, (None, 1.5)]):
            run = r if k in starts else None if run is None or r is None else run * r
            want[d] = run
        got = {x.d: x.cum_r for x in transform.cumulate(df, "r", method, "d", time=time).collect()}
        assert {k: v is None for k, v in got.items()} == {k: v is None for k, v in want.items()}
        assert all(v is None or v == pytest.approx(want[k]) for k, v in got.items())


def test_cumulate_arguments(panel):
    with pytest.raises(NotImplementedError):
        transform.cumulate(panel, "RET", "zero")
    with pytest.raises(ValueError):
        transform.cumulate(panel, "RET", "between")


def test_portfolio_puts_missing_values_in_zero(spark, panel):
    df = panel.selectExpr("PERMNO", "byvar", "Date", "if(RET = 1.01, null, RET) as RET")
    assert values(portfolio.portfolio(df, "RET", 2, byvars=["PERMNO", "byvar"]), "portfolio") == [0, 1, 1, 2]


def test_groupby_merge_with_null_keys(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3), ("b", 4)], "byvar string, val long")
    got = {(r.byvar, r.val): r.val_sum for r in merge.groupby_merge(df, "byvar", "sum").collect()}
    assert got == {("a", 1): 1, (None, 2): None, ("b", 3): 7, ("b", 4): 7}
    own = {r.val: r.val_transform for r in merge.groupby_merge(df, "byvar", "transform", lambda s: s - s.max(), subset="val").collect()}
    assert own == {1: 0, 2: 0, 3: -1, 4: 0}
    with pytest.raises(ValueError, match="known are"):
        merge.groupby_merge(df, "byvar", "nosuch")


def test_as_of_join_keeps_ties_and_unmatched_rows(spark):
    day = dt.date.fromisoformat
    left = spark.createDataFrame([("1", day("1995-03-01")), ("1", day("1995-04-01")), ("2", None), (None, day("2000-01-01")), ("1", day("1990-01-01"))], "k string, Date date")
    right = spark.createDataFrame([("1", day("1995-02-01"), 1), ("1", day("1995-03-02"), 2), ("1", day("1995-03-02"), 3), (None, day("1999-01-01"), 4)], "k string, Date date, v int")
    got = sorted(((r.k, r.Date, r.Date_y, r.v) for r in merge.left_merge_latest(left, right, "k").collect()), key=str)
    want = [("1", day("1990-01-01"), None, None), ("1", day("1995-03-01"), day("1995-02-01"), 1), ("1", day("1995-04-01"), day("1995-03-02"), 2), ("1", day("1995-04-01"), day("1995-03-02"), 3), ("2", None, None, None), (None, day("2000-01-01"), None, None)]
    assert got == sorted(want, key=str)


def test_regression(panel):
    df = panel.withColumn("weight", transform.F.expr("element_at(array(0,1,1,0,1,1,1,1,0,0,0,1), cast(round((RET - 1) * 100) as int))"))
    plain = [r.coef_RET for r in regression.reg_by(df, "weight", "RET", ["PERMNO", "byvar"], cons=False).orderBy("PERMNO", "byvar").collect()]
    assert plain == pytest.approx([0.487746, 0.938863, 0.229292], abs=1e-5)
    const = [(r.const, r.coef_RET) for r in regression.reg_by(df, "weight", "RET", ["PERMNO", "byvar"]).orderBy("PERMNO", "byvar").collect()]
    assert const[0] == pytest.approx((0.5, 0), abs=1e-8) and const[2] == pytest.approx((-32.9, 30), abs=1e-6)
    few = regression.reg_by(df.filter("RET < 1.1"), "weight", "RET", ["PERMNO", "byvar"], stderr=True).filter("PERMNO = 10517").first()
    assert few.const is None and few.stderr_RET is None


def test_long_to_wide(panel):
    wide = transform.long_to_wide(panel, ["PERMNO", "byvar"], "RET", "Date")
    assert wide.columns[2:] == [f"RET1/{d}/2000" for d in range(1, 5)] and wide.count() == 3
    twice = panel.withColumn("RET", panel.RET + 1).union(panel)
    with pytest.raises(Exception, match="more than one"):
        transform.long_to_wide(twice, ["PERMNO", "byvar"], "RET", "Date").collect()


def test_long_to_wide_drops_repeated_rows_without_colindex(spark, panel):
    once = transform.long_to_wide(panel, ["PERMNO", "byvar"], "RET")
    again = transform.long_to_wide(panel.union(panel.limit(3)), ["PERMNO", "byvar"], "RET")
    assert once.columns == again.columns == ["PERMNO", "byvar", "Date", *(f"RET{k}" for k in range(4))] and once.count() == again.count() == 12
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))
    both = spark.createDataFrame([(1, "1", "23", 5), (1, "12", "3", 6)], "g int, a string, b string, v int")
    assert transform.long_to_wide(both, "g", "v", ["a", "b"]).first().asDict() == {"g": 1, "v_12_3": 6, "v_1_23": 5}
    spark.conf.set("spark.sql.pivotMaxValues", "3")
    with pytest.raises(ValueError, match="more than 3"):
        transform.long_to_wide(panel, ["PERMNO", "byvar"], "RET", "Date")
    spark.conf.unset("spark.sql.pivotMaxValues")


def test_expand_time_takes_a_number(spark):
    month = spark.createDataFrame([(dt.date(2000, 2, 29),)], "Date date")
    assert [str(r["Shift Date"])[:10] for r in dates.expand_time(month, freq="a", time=1).collect()] == ["2001-02-28"]
    assert dates.expand_time(month, time=12).first()["Shift"] == 12


def test_readers_and_display(spark, panel, tmp_path, capsys):
    panel.write.parquet(str(tmp_path / "p.parquet"))
    panel.coalesce(1).write.option("header", True).csv(str(tmp_path / "p.csv"))
    assert load.read_file(spark, str(tmp_path / "p.parquet")).count() == load.read_file(spark, str(tmp_path / "p.csv")).count() == 12
    with pytest.raises(NotImplementedError):
        load.read_file(spark, "p.xyz")
    again = eval(show.to_copy_paste(panel.limit(2)))  # noqa: S307
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, panel.limit(2).collect()))
    assert eval(show.to_copy_paste(panel.limit(1), column_names=False)).columns == ["c0", "c1", "c2", "c3"]  # noqa: S307
    assert [show.ordinal(n) for n in (1, 2, 3, 4, 11, 12, 13, 21, 112)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "112th"]
    assert show.df_types_dict(panel) == {"PERMNO": "int", "byvar": "string", "Date": "string", "RET": "double"}
    narrow = show.optimized_df(spark.createDataFrame([(1, 300, 1.5), (-100, 70_000, None)], "a long, b long, c double"), floats=True)
    assert dict(narrow.dtypes) == {"a": "tinyint", "b": "int", "c": "float"}
    left = show.estimate_time(10, 4, time.perf_counter() - 5) - dt.datetime.now()
    assert 4 < left.total_seconds() < 6 and "5 of 10" in capsys.readouterr().out


def test_sas_files_are_read_once(spark, monkeypatch, tmp_path):
    calls = []

    def read_sas(path, encoding, chunksize=None):
        calls.append(encoding)
        if encoding == "utf-8":
            raise UnicodeDecodeError("utf-8", b"x", 0, 1, "no")
        frames = [load.pd.DataFrame({"a": [1, 2], "b": ["x", "ü"]}), load.pd.DataFrame({"a": [3], "b": ["z"]})]
        return iter(frames) if chunksize else load.pd.concat(frames)

    monkeypatch.setattr(load.pd, "read_sas", read_sas)
    for csv in (False, True):
        path = tmp_path / f"{csv}.sas7bdat"
        path.write_bytes(b"")
        os.utime(path, (1, 1))
        for n in (2, 2):  # the second time the copy is read
            assert sorted(map(tuple, load.load_sas(spark, str(path), csv).collect())) == [(1, "x"), (2, "ü"), (3, "z")] and len(calls) == n + 2 * csv
    only = load.load_sas(spark, str(tmp_path / "True.sas7bdat"), True, inferSchema=False)
    assert dict(only.dtypes) == {"a": "string", "b": "string"} and len(calls) == 4
    assert load.load_sas(spark, str(tmp_path / "x.sas7bdat"), cache=False, encodings=("cp1252",)).count() == 3
    assert dates.year_month_from_single_date(dt.date(2001, 5, 9)) == (2001, 5)
    assert show.df_types_dict(spark.createDataFrame([(1, dt.date(2000, 1, 1))], "a int, date date")) == {"a": "int"}


def test_errors_of_several_regressors_equal_the_plain_formula(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(5, 1, (60, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=60) * x[:, 0]
    df = spark.createDataFrame([(k % 2, float(a), float(b), float(c)) for k, ((a, b), c) in enumerate(zip(x, y))], "g int, a double, b double, y double")
    for cons in (True, False):
        got = {r.g: r for r in regression.reg_by(df, "y", ["a", "b"], "g", cons=cons, stderr=True).collect()}
        for g in (0, 1):
            z = np.c_[np.ones(30), x[g::2]] if cons else x[g::2]
            inverse = np.linalg.inv(z.T @ z)
            b = inverse @ z.T @ y[g::2]
            e = y[g::2] - z @ b
            wide = inverse @ (z.T * e**2) @ z @ inverse * 30 / (30 - z.shape[1])
            names = [*(["const"] if cons else []), "a", "b"]
            assert [got[g][f"stderr_{n}"] for n in names] == pytest.approx(np.sqrt(np.diag(wide)), rel=1e-8)
            assert [got[g]["const" if n == "const" else f"coef_{n}"] for n in names] == pytest.approx(b, rel=1e-8)


def test_null_keys_and_options_of_the_as_of_join(spark, panel):
    with pytest.raises(ValueError):
        merge.left_merge_latest(panel, panel, "byvar", backend="nosuch")
    one = spark.createDataFrame([("a", 5)], "k string, Date int")
    other = spark.createDataFrame([("a", 4, 7), ("a", 5, 8), ("a", 6, 9)], "k string, Date int, v int")
    assert [tuple(r) for r in merge.left_merge_latest(one, other, "k", backend="sql", low_memory=True).collect()] == [("a", 5, 5, 8)]


def test_dates_and_holidays(spark):
    df = spark.createDataFrame([(16114.0,), (None,)], "d double")
    assert [str(r[0])[:10] for r in df.select(dates.convert_sas_date(df.d)).collect()] == ["2004-02-13", "None"]
    assert dates.easter(2000) == dt.date(2000, 4, 23) and dates.easter(2024) == dt.date(2024, 3, 31)
    month = spark.createDataFrame([(dt.date(2000, 1, 15),)], "Date date")
    assert dates.expand_months(month).count() == 20 and dates.expand_months(month, trade_days=False).count() == 31
    shifted = {r.Shift: str(r["Shift Date"])[:10] for r in dates.expand_time(month, True, freq="d", time=[-1, 2]).collect()}
    assert shifted == {-1: "2000-01-14", 0: "2000-01-18", 1: "2000-01-18", 2: "2000-01-19"}


def test_fill(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", "x", None), ("b", None, None)], "g string, s string, v double")
    assert sorted(fill.fillna_by_groups(df, "g").collect(), key=str) == sorted([("a", "x", 1.0), ("a", "x", 1.0), ("b", None, None)], key=str)
    full = fill.fill_excluded_rows(spark.createDataFrame([(1, 1, 5), (2, 2, 6), (None, 3, 7)], "a int, b int, v int"), ["a", "b"], value=0)
    assert sorted(map(tuple, full.collect())) == [(1, 1, 5), (1, 2, 0), (1, 3, 0), (2, 1, 0), (2, 2, 6), (2, 3, 0)]


def test_strings_and_selection(spark):
    df = spark.createDataFrame([("TX", 1, None), ("XX", 2, 1)], "s string, a int, b int")
    assert [r.s for r in strings.state_abbrev(df, "s").collect()] == ["Texas", "XX"]
    assert transform.select_rows_by_condition_on_columns(df, ["b"], "!= 1").count() == 1
    assert [r[0] for r in df.select(strings.join_col_strings(["s", "b"])).collect()] == ["TX_nan", "XX_1"]
    assert sql_plan.table_names("with q as (select 1 from a) select * from q join b on true") == ["a", "b"]


def test_the_library_stands_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['panelspark.llm'] = None; import panelspark.plans.queries, panelspark.sources.load, panelspark.sources.show"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0
