"""The command line on landed CSV files (written from the sf0.001 stand-ins)."""

import os

from weekpanel import cli
from weekpanel.plans import standin
from weekpanel.session import scratch_path
from weekpanel.sources.sinks import write_csv

from .conftest import SF_SMALL


def land(spark):
    root = scratch_path(spark, "t-cli")
    inp = standin.inputs(spark, SF_SMALL)
    paths = {"cases": os.path.join(root, "cases"), "mapping": os.path.join(root, "mapping"), "sheets": []}
    write_csv(inp.cases_raw, paths["cases"])
    write_csv(inp.mapping.orderBy("src_row").drop("src_row").coalesce(1), paths["mapping"])
    for v, parts in inp.sheets.items():
        files = []
        for i, sh in enumerate(parts, 1):
            f = os.path.join(root, f"{v}_{i}")
            write_csv(sh.orderBy("src_row").drop("src_row").coalesce(1), f)  # a landed sheet is one file in row order
            files.append(f)
        paths["sheets"] += ["--sheet", f"{v}=" + ",".join(files)]
    return root, paths, inp


def test_cli_integrate_validate_stations(spark, capsys):
    from weekpanel.plans.integrate import build_panel

    root, p, inp = land(spark)
    out = os.path.join(root, "out")
    alias = ["--alias", "NATION_3=Nation_2"]  # the stand-in's extra alias
    rc = cli.main(["integrate", "--cases", p["cases"], "--mapping", p["mapping"], *p["sheets"], "--out", out, *alias],
                  spark=spark)
    assert rc == 0
    written = spark.read.parquet(os.path.join(out, "panel"))
    expected = build_panel(inp)
    assert written.count() == expected.count() == 8736
    cols = expected.columns
    assert written.select(*cols).exceptAll(expected).count() == 0
    assert "Missing data by column" in capsys.readouterr().out
    assert cli.main(["validate", "--cases", p["cases"], "--panel", os.path.join(out, "panel"), *alias], spark=spark) == 0
    assert cli.main(["stations", "--mapping", p["mapping"], *p["sheets"]], spark=spark) == 0
    text = capsys.readouterr().out
    assert "Ghost Obs. (°C)" in text and "Mapping stations not found" in text


def test_cli_missing_input(spark, capsys):
    assert cli.main(["eda", "--cases", "/nonexistent/weekpanel/cases"], spark=spark) == 2
    assert "input not found" in capsys.readouterr().err


def test_cli_preprocess_and_eda(spark, capsys):
    from weekpanel.operators.reshape import cases_long_from_wide
    from weekpanel.sources.readers import scan_cases

    wide = standin.cases_wide(spark, SF_SMALL)
    root = scratch_path(spark, "t-cli-pre")
    write_csv(wide, os.path.join(root, "wide"))
    out = os.path.join(root, "long")
    assert cli.main(["preprocess", "--wide", os.path.join(root, "wide"), "--out", out], spark=spark) == 0
    got = scan_cases(spark, out)
    assert got.exceptAll(cases_long_from_wide(wide)).count() == 0 and got.count() == cases_long_from_wide(wide).count()
    assert cli.main(["eda", "--cases", out], spark=spark) == 0
    text = capsys.readouterr().out
    assert "Top 20 districts" in text and "Describe" in text
