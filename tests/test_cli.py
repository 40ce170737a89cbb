"""Whole runs from the command line."""

import json

import pytest

from rulespan import cli

CONFIG = """from rulespan.plans.architecture import Architecture
from rulespan.plans.presets import Psr12
architecture = Architecture().with_preset(Psr12(["src"])).baseline({baseline!r}).cache_directory({cache!r})
"""


@pytest.fixture
def project(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "composer.json").write_text('{"autoload": {"psr-4": {"App\\\\": "src/", "Gone\\\\": "gone"}}}')
    (tmp_path / "src/Good.php").write_text("<?php\nnamespace App;\nclass Good { public function run(): int { return 1; } }\n")
    (tmp_path / "src/bad_one.php").write_text("<?php\nnamespace App;\nclass bad_one {\n    const low = 1;\n    function Run() {}\n}\n")

    def configure(baseline=None, cache=None):
        (tmp_path / "architecture.py").write_text(CONFIG.format(baseline=baseline, cache=cache))

    configure()
    return tmp_path, configure


def run(capsys, *args):
    code = cli.main(list(args))
    return code, capsys.readouterr().out


def test_analyse_and_baseline(spark, project, capsys, monkeypatch):
    base, configure = project
    monkeypatch.setattr(spark, "stop", lambda: None)
    code, out = run(capsys, "analyse", "--base-path", str(base), "--report", "json")
    found = json.loads(out)
    want = {"psr4.source_paths.must_exist_on_disk", "psr1.classes.must_be_studly_caps", "psr1.class_constants.must_be_upper_case", "psr1.methods.must_be_camel_case", "psr12.methods.must_declare_visibility", "psr12.constants.must_declare_visibility"}
    assert code == 1 and {v["rule"] for v in found["violations"]} == want and found["total"] == 6
    assert run(capsys, "analyse", "--base-path", str(base), "--generate-baseline", "accepted")[0] == 0
    configure("accepted", "cache")
    for _ in range(2):  # the second time from cached facts
        code, out = run(capsys, "analyse", "--base-path", str(base))
        assert code == 0 and "No violations found" in out
    (base / "src/Good.php").write_text("<?php\nnamespace App;\nclass Good { function run(): int { return 1; } }\n")
    code, out = run(capsys, "analyse", "--base-path", str(base))
    assert code == 1 and "Found 1 violation(s):" in out and "psr12.methods.must_declare_visibility" in out
    with pytest.raises(AssertionError, match="Good::run"):
        cli.assert_no_violations(spark, str(base))
    assert run(capsys, "clear-cache", "--base-path", str(base))[0] == 0


def test_no_configuration(spark, tmp_path, capsys):
    assert cli.main(["analyse", "--base-path", str(tmp_path)]) == 1
    (tmp_path / "architecture.dist.py").write_text("x = 1\n")
    with pytest.raises(cli.ConfigError):
        cli.load(cli.discover(str(tmp_path)))


def test_scaffold_and_streamed_report(spark, project, capsys, monkeypatch):
    base, _ = project
    monkeypatch.setattr(spark, "stop", lambda: None)
    code = run(capsys, "analyse", "--base-path", str(base), "--output", str(base / "out"))[0]
    lines = [json.loads(x) for f in (base / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert code == 1 and len(lines) == 6 and all(x["layer"] == "Source" or x["rule"] for x in lines)
    assert run(capsys, "init", "--base-path", str(base))[0] == 1, "there is a configuration"
    (base / "architecture.py").unlink()
    assert run(capsys, "init", "--base-path", str(base))[0] == 0 and cli.load(cli.discover(str(base))).rules
