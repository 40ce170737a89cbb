"""Sources before and after fixes."""

import pytest

from rulespan import rules as R
from rulespan.plans import analysis, fixes
from rulespan.plans.architecture import Architecture
from rulespan.rules.base import Facts
from rulespan.sources.php_facts import extract


@pytest.mark.parametrize("before,actions,after", [
    ("<?php\n#[A]\nclass X {}", [("add_final", "X", None)], "<?php\n#[A]\nfinal class X {}"),
    ("<?php readonly class X {}", [("add_final", "X", None)], "<?php final readonly class X {}"),
    ("<?php abstract class X {}", [("add_final", "X", None)], "<?php abstract class X {}"),
    ("<?php namespace N; class X {} class Y {}", [("add_abstract", "N\\Y", None)], "<?php namespace N; class X {} abstract class Y {}"),
    ("<?php class X { static function a() {} function b() {} }", [("add_public_method", "X", "a")], "<?php class X { public static function a() {} function b() {} }"),
    ("<?php class X { const A = 1; var $p; readonly int $q; }", [("add_public_constant", "X", "A"), ("add_public_property", "X", "p"), ("add_public_property", "X", "q")], "<?php class X { public const A = 1; public $p; public readonly int $q; }"),
    ("<?php class X { function __construct(readonly int $q) {} }", [("add_public_property", "X", "q")], "<?php class X { function __construct(public readonly int $q) {} }"),
    ("<?php use A\\B;\nclass X {}\nclass Y {}", [("remove_class", "X", None)], "<?php use A\\B;\n\nclass Y {}"),
    ("<?php namespace N; use A\\B; interface X {}", [("remove_class", "N\\X", None)], None),
    ("﻿<?PHP echo 1 ?><b><? echo 2 ?><?= 3 ?>", [("strip_bom", "", None), ("normalise_tags", "", None)], "<?php echo 1 ?><b><?php echo 2 ?><?= 3 ?>"),
    ("﻿<?php class {", [("add_final", "X", None)], "﻿<?php class {"),
])
def test_fixed(before, actions, after):
    assert fixes.fixed(before, actions) == after


def test_missing_paths():
    config = {"name": "x", "autoload": {"psr-4": {"A\\": "gone", "B\\": ["gone", "src"]}}, "autoload-dev": {"psr-4": {"T\\": "gone"}}}
    assert fixes.without_missing_paths(config, lambda p: p == "src") == {"name": "x", "autoload": {"psr-4": {"B\\": ["src"]}}}


def test_fix_until_stable(spark):
    # removing the unused child leaves its parent unused, so a second pass is needed
    rows = [("a.php", b"<?php abstract class ParentOne {}"), ("b.php", b"<?php abstract class ChildOne extends ParentOne {}"), ("c.php", b"<?php class Used { const A = 1; } $u = new Used;")]
    a = Architecture().layer_pattern("L", "/./").rule("unused", R.MustBeUsedAbstractClass("L")).rule("visibility", R.MustDeclareConstantVisibility("L"))

    def plan_of(files):
        return analysis.fix_plan(a, analysis.violations(a, Facts(**extract(files))))

    out, passes = fixes.fix_until_stable(spark.createDataFrame(rows, "file string, content binary"), plan_of)
    assert {r.file: bytes(r.content) for r in out.collect()} == {"c.php": b"<?php class Used { public const A = 1; } $u = new Used;"} and passes == 2
