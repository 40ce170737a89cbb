"""Facts of PHP source."""

import pytest

from rulespan import rules as R
from rulespan.plans import analysis, presets
from rulespan.plans.architecture import Architecture
from rulespan.rules.base import Facts
from rulespan.sources.php_facts import extract, facts_of
from rulespan.sources.scan import scan


def facts(code):
    return facts_of("f.php", code.encode())


def node(code, i=0):
    return facts(code)["nodes"][i]


def test_dependencies_and_imports():
    n = node(r"""<?php
namespace App\Http;
use Lib\{Tool, Deep\Other as O};
use function Lib\helper, strlen;
use const Lib\LIMIT;
final class Page extends Base implements \Countable, O {
    use Mixed_;
    public const A = 1, B = Tool::X;
    private ?Model $m = null;
    public function __construct(private readonly Repo|Own $r, int $n = LIMIT) {}
    #[Route('/x')]
    protected static function go(self $x, callable $f): ?Result {
        if ($x instanceof Check && $f() || true) { return new Result(namespace\Rel::make()); }
        try { helper(); plain(); } catch (Bad | \Worse $e) { throw $e; }
        return match ($x) { 1, 2 => null, default => fn(Arg $a): Ret => $a?->x ?? 3 };
    }
}
use Late\Import;
""")
    assert n["class_name"] == "App\\Http\\Page" and n["extends"] == "App\\Http\\Base" and n["implements"] == ["Countable", "Lib\\Deep\\Other"] and n["traits"] == ["App\\Http\\Mixed_"] and n["is_final"]
    assert n["dependencies"] == ["Lib\\Tool", "Lib\\Deep\\Other", "Lib\\helper", "strlen", "Lib\\LIMIT", "App\\Http\\Base", "Countable", "App\\Http\\Mixed_", "App\\Http\\Model", "App\\Http\\Repo", "App\\Http\\Own",
                                 "App\\Http\\Route", "App\\Http\\Result", "App\\Http\\Check", "App\\Http\\Rel", "App\\Http\\Bad", "Worse", "App\\Http\\Arg", "App\\Http\\Ret"]
    assert n["function_calls"] == ["Lib\\helper", "plain"]
    assert [(c["name"], c["visibility"], c["has_explicit_visibility"]) for c in n["constants"]] == [("A", "public", True), ("B", "public", True)]
    assert [p["name"] for p in n["properties"]] == ["m", "r"]
    a, b = n["methods"]
    assert (a["name"], a["param_count"], a["line_count"], a["is_magic"]) == ("__construct", 2, 0, True)
    # 1, if, &&, ||, catch, two arms
    assert (b["name"], b["visibility"], b["is_static"], b["has_return_type"], b["cyclomatic_complexity"], b["line_count"]) == ("go", "protected", True, True, 7, 3)


@pytest.mark.parametrize("body,complexity", [
    ("return match (true) { 1 => 2, 3 => 4, 5 => 6, default => 7 };", 5), ("switch ($a) { case 1: break; default: break; }", 3), ("do { $x ?: 1; } while ($a and $b);", 4), ("do if ($x) {} while ($a); while ($b) {}", 4),
    ("foreach ($a as $b) for (;;) {} return $a ?? $b xor $c;", 3), ("$f = function () { if (1) {} elseif (2) {} else if (3) {} };", 4), ("new class { function x() { if (1) {} } };", 2), ("return $a?->b;", 1),
])
def test_complexity(body, complexity):
    assert node(f"<?php class A {{ function m() {{ {body} }} }}")["methods"][0]["cyclomatic_complexity"] == complexity


def test_lengths_and_lines():
    m = node("<?php\nabstract class A {\n  abstract function a();\n  function b() {\n\n    $x = 1;\n    return [\n      1,\n    ];\n\n  }\n}")["methods"]
    assert [(x["line_count"], x["line"]) for x in m] == [(0, 3), (4, 4)]


def test_uses_of_globals_and_constructs():
    n = node("<?php class A { function m() { echo $_POST['x'], $_GET['y'], $_POST['z']; exit(1); die; list($a) = isset($b) ? [1] : empty($c); require_once 'x.php'; DD(1); } }")
    assert n["superglobals"] == ["$_POST", "$_GET"] and n["language_constructs"] == ["echo", "exit", "die", "list", "isset", "empty", "require_once"] and n["function_calls"] == ["DD"]


def test_references_and_strings():
    f = facts(r"""<?php namespace N; use X\Y; $a = new Z; \g(); $s = '\App\Thing'; $t = "not a name!"; $u = "va{$x}r"; const C = 1; class K { const S = 'In\Class_'; } echo 'true';""")
    assert f["references"] == [{"file": "f.php", "references": ["N\\Z", "g", "App\\Thing", "In\\Class_"]}]


def test_instantiations():
    f = facts(r"""<?php namespace N;
class A extends P { function m() { new B; new self; new static; new parent; new ('C' . 'D'); new (E::class); (new \ReflectionClass(F::class))->newInstanceArgs([]); new $x; } }
trait T { function m() { new self; new parent; new static; } }
$o = new class(1) extends Q implements R { use T; function m() { new parent; new self; } };""")
    got = {(t["keyword"], t["class_name"]) for t in f["instantiations"][0]["targets"]}
    assert got == {(None, "N\\B"), (None, "N\\A"), ("static", "N\\A"), (None, "N\\P"), (None, "CD"), (None, "N\\E"), (None, "N\\F"), (None, "ReflectionClass"), ("self", "N\\T"), ("parent", "N\\T"), ("static", "N\\T"), (None, "N\\Q")}
    assert f["anonymous"] == [{"file": "f.php", "line": 4, "extends": "N\\Q", "implements": ["N\\R"], "traits": ["N\\T"]}] and [n["class_name"] for n in f["nodes"]] == ["N\\A", "N\\T"]


def test_kinds():
    f = facts("<?php interface I extends J, K {} enum E: string implements I { case A = 'x'; case B = 'y'; const C = self::A; public function f(): string { return ''; } } readonly class R {} abstract class Q { public string $x { get => 1; set { $this->x = 2; } } }")
    assert [(n["is_interface"], n["is_enum"], n["is_readonly"], n["is_abstract"]) for n in f["nodes"]] == [(True, False, False, False), (False, True, False, False), (False, False, True, False), (False, False, False, True)]
    assert f["nodes"][0]["interface_extends"] == ["J", "K"] and f["nodes"][1]["implements"] == ["I"]


@pytest.mark.parametrize("code,declares,effects,line", [
    ("<?php class A {}", True, False, 1), ("<?php\necho 1;", False, True, 2), ("<?php\nclass A {}\n\n$x = 1;", True, True, 4), ("<?php define('A', 1);", True, False, 1), ("<?php defined('A') || define('A', 1);", True, False, 1),
    ("<?php declare(strict_types=1); namespace N; use A\\B; function f() { echo 1; }", True, False, 1), ("<?php if (!function_exists('f')) { function f() {} }", True, False, 1), ("text <?php class A {}", True, True, 1),
    ("<?php\nif (true) {\n  include 'x';\n}", False, True, 3), ("<?php return ['a' => 1];", False, False, 1),
])
def test_side_effects(code, declares, effects, line):
    a = facts(code)["analyses"][0]
    assert (a["declares_symbols"], a["has_side_effects"], a["side_effect_line"], a["has_valid_ast"]) == (declares, effects, line, True)


@pytest.mark.parametrize("code,line", [("<?php echo 1 ?>\n<?= 2 ?>", None), ("a\n<? echo 1;", 2), ("<?PHP echo 1;", 1), ("<?xml version='1'?>\n<?php", None), ("<?php ?>\n\n<?hh", 3)])
def test_tags(code, line):
    assert facts(code)["analyses"][0]["invalid_php_tag_line"] == line


@pytest.mark.parametrize("code", ["<?php class A {", "<?php 'open", "<?php /* open", "<?php class A { function }", "<?php <<<X\nabc", "<?php f(]"])
def test_broken_files_have_no_classes(code):
    f = facts(code)
    assert f["nodes"] == [] and not f["analyses"][0]["has_valid_ast"]


def test_heredocs_comments_and_html():
    f = facts("<b><?php // it's fine ?>\n<i><?php\n# one\n/* two */ class A { const X = <<<'T'\n  class B {}\n  T; const Y = <<<U\nx {$y}\nU; }\n")
    assert [n["class_name"] for n in f["nodes"]] == ["A"] and [c["line"] for c in f["nodes"][0]["constants"]] == [4, 6]


def test_project_end_to_end(spark, tmp_path):
    sources = {
        "src/Domain/UserEntity.php": "<?php\nnamespace App\\Domain;\nuse App\\Infrastructure\\Db;\nclass UserEntity { public function name() { return (new Db)->get(); } }",
        "src/Domain/Order.php": "<?php\nnamespace App\\Domain;\nfinal class Order { public function total(): int { if (1) { die(); } return 1; } }",
        "src/Infrastructure/Db.php": "\ufeff<?php\nnamespace App\\Infrastructure;\nclass Db { function get(): array { return []; } }\necho 1;",
        "src/Broken.php": "<?php class {",
    }
    for name, code in sources.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(code)
    tables = extract(scan(spark, ["src"], base_path=str(tmp_path)))
    a = Architecture().with_preset(presets.Ddd()).rule("bom", R.Psr1Utf8WithoutBom()).rule("effects", R.Psr1SymbolsOrSideEffects()).ruleset({"Domain": []})
    found = {(r.rule_key, r.class_name.rpartition("\\")[2]) for r in analysis.violations(a, Facts(base_path=str(tmp_path), **tables)).collect()}
    assert found == {("ddd.layer.domain_not_depend_infrastructure", "UserEntity"), ("ddd.entity.must_be_final", "UserEntity"), ("ddd.entity.must_have_return_types", "UserEntity"), ("ruleset.Domain", "UserEntity"),
                     ("ddd.safety.domain_no_die", "Order"), ("ddd.safety.domain_no_exit", "Order"), ("bom", ""), ("effects", "")}
