"""The whole analysis of a small folder, through the command line."""

import json

from cohortlens import cli
from cohortlens.operators import synth
from cohortlens.sources.matrix import to_wide


def test_command_line(spark, tmp_path):
    m, _ = synth.synthetic_matrix(spark, 60, n_genes=6, n_virulence=0)
    names = [r["feature"] for r in m.features.orderBy("ord").collect()]
    (tmp_path / "in").mkdir()
    to_wide(m, names).withColumnRenamed("row", "Strain_ID").toPandas().to_csv(tmp_path / "in" / "data.csv", index=False)
    assert cli.main(["--data-dir", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--bootstrap", "200"]) == 0
    summary = json.loads((tmp_path / "out" / "summary.json").read_text())
    assert not summary["failed"] and summary["rows"]["overview"] == 1 and (tmp_path / "out" / "report.html").exists()
    assert cli.main(["--data-dir", str(tmp_path / "nothing")]) == 1
    assert cli.main(["--bootstrap", "3"]) == 1
