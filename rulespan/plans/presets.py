"""Bundles of layers and rules for widespread conventions. Keys, names, paths and limits are fixed values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from rulespan import rules as R
from rulespan.plans.architecture import Architecture

_DEBUG, _EXITS = ("dd", "dump", "var_dump", "print_r"), ("die", "exit")
_MIDDLEWARE, _HANDLER = "Psr\\Http\\Server\\MiddlewareInterface", "Psr\\Http\\Server\\RequestHandlerInterface"


def _source(a: Architecture, paths: Sequence[str] | None) -> str:
    layer = a.source_layer(paths)
    a.layer(layer, paths or ())
    return layer


@dataclass(frozen=True)
class Psr4:
    paths: Sequence[str] | None = None

    def __call__(self, a: Architecture) -> None:
        layer, paths = _source(a, self.paths), a.register_source_paths("psr4", self.paths)
        a.rule("psr4.classes.must_match_composer", R.Psr4Namespace(layer)).rule("psr4.source_paths.must_be_in_composer", R.Psr4SourcePaths(paths))
        a.rule("psr4.source_paths.must_exist_on_disk", R.Psr4DirectoryExists()).rule("psr4.source_paths.must_not_be_root", R.Psr4RootPath())
        a.rule("psr4.namespace_prefix.must_not_be_empty", R.Psr4EmptyNamespacePrefix())


@dataclass(frozen=True)
class Psr1:
    paths: Sequence[str] | None = None

    def __call__(self, a: Architecture) -> None:
        a.with_preset(Psr4(self.paths))
        layer, paths = a.source_layer(self.paths), a.register_source_paths("psr1", self.paths)
        a.rule("psr1.files.must_use_valid_tags", R.Psr1PhpTags(paths)).rule("psr1.files.must_use_valid_utf8", R.Psr1ValidUtf8(paths))
        a.rule("psr1.files.must_use_utf8_without_bom", R.Psr1Utf8WithoutBom(paths)).rule("psr1.files.should_declare_symbols_or_side_effects", R.Psr1SymbolsOrSideEffects(paths))
        a.rule("psr1.classes.must_be_studly_caps", R.ClassNameMustBeStudlyCaps(layer)).rule("psr1.class_constants.must_be_upper_case", R.ClassConstantNameMustBeUpperCase(layer))
        a.rule("psr1.methods.must_be_camel_case", R.MethodNameMustBeCamelCase(layer))


@dataclass(frozen=True)
class Psr12:
    paths: Sequence[str] | None = None

    def __call__(self, a: Architecture) -> None:
        a.with_preset(Psr1(self.paths))
        layer = a.source_layer(self.paths)
        a.rule("psr12.methods.must_declare_visibility", R.MustDeclareMethodVisibility(layer)).rule("psr12.constants.must_declare_visibility", R.MustDeclareConstantVisibility(layer))
        a.rule("psr12.properties.must_declare_visibility", R.MustDeclarePropertyVisibility(layer))


@dataclass(frozen=True)
class Psr15:
    paths: Sequence[str] | None = None

    def __call__(self, a: Architecture) -> None:
        layer = _source(a, self.paths)
        a.rule("psr15.middleware.must_implement_middleware_interface", R.MustImplementInterface(layer, _MIDDLEWARE, "/Middleware$/"))
        a.rule("psr15.handler.must_implement_request_handler_interface", R.MustImplementInterface(layer, _HANDLER, "/Handler$/"))
        a.rule("psr15.middleware_interface_implementation.must_have_middleware_suffix", R.ClassImplementingInterfaceMustHaveSuffix(layer, _MIDDLEWARE, "Middleware"))
        a.rule("psr15.request_handler_interface_implementation.must_have_handler_suffix", R.ClassImplementingInterfaceMustHaveSuffix(layer, _HANDLER, "Handler"))


@dataclass(frozen=True)
class Yagni:
    paths: Sequence[str] | None = None

    def __call__(self, a: Architecture) -> None:
        layer = _source(a, self.paths)
        a.rule("yagni.interface.must_be_used", R.MustBeUsedInterface(layer)).rule("yagni.abstract_class.must_be_used", R.MustBeUsedAbstractClass(layer))
        a.rule("yagni.trait.must_be_used", R.MustBeUsedTrait(layer)).rule("yagni.extended_class.must_be_abstract_or_instantiated", R.ExtendedClassMustBeAbstractOrInstantiated(layer))


@dataclass(frozen=True)
class Ddd:
    max_complexity: int = 5
    max_length: int = 20
    final_entities: bool = True
    final_value_objects: bool = True
    final_events: bool = True

    def __call__(self, a: Architecture) -> None:
        for layer in ("Domain", "Application", "Infrastructure"):
            if layer not in a.layers:
                a.layer(layer, f"src/{layer}/")
        for source, target in (("Domain", "Application"), ("Domain", "Infrastructure"), ("Application", "Infrastructure")):
            a.rule(f"ddd.layer.{source.lower()}_not_depend_{target.lower()}", R.MayNotDependOn(source, target, target))
        for wanted, key, pattern in ((self.final_entities, "entity", "/Entity$/"), (self.final_value_objects, "value_object", "/ValueObject$/"), (self.final_events, "event", "/Event$/")):
            if wanted:
                a.rule(f"ddd.{key}.must_be_final", R.MustBeFinal("Domain", pattern))
        a.rule("ddd.entity.must_have_return_types", R.MustHaveReturnType("Domain", "/Entity$/"))
        a.rule("ddd.value_object.no_datetime", R.MayNotUseClass("Domain", "DateTime", "/ValueObject$/"))
        a.rule("ddd.repository.must_be_interface", R.MustBeInterface("Domain", "/Repository$/"))
        a.rule("ddd.repository.implementation_in_infrastructure", R.NamingConvention("/Repository$/", "Infrastructure", exclude_interfaces=True))
        a.rule("ddd.service.domain_service_in_domain", R.NamingConvention("/DomainService$/", "Domain"))
        a.rule("ddd.service.app_service_in_application", R.NamingConvention("/Service$/", "Application", exclude="/DomainService$/"))
        a.rule("ddd.event.must_be_in_domain", R.NamingConvention("/Event$/", "Domain")).rule("ddd.event.no_datetime", R.MayNotUseClass("Domain", "DateTime", "/Event$/"))
        a.rule("ddd.safety.domain_no_datetime", R.MayNotUseClass("Domain", "DateTime")).rule("ddd.safety.domain_no_base_exception", R.MayNotUseClass("Domain", "Exception"))
        a.rule("ddd.safety.domain_no_json_serializable", R.MayNotImplementInterface("Domain", "JsonSerializable"))
        for layer in ("Domain", "Application"):
            key = f"ddd.safety.{layer.lower()}"
            a.rule(f"{key}_max_complexity", R.MaxCyclomaticComplexity(layer, self.max_complexity)).rule(f"{key}_max_method_length", R.MaxMethodLength(layer, self.max_length))
            _safety(a, key, layer, _DEBUG)


def _safety(a: Architecture, key: str, layer: str, functions: Sequence[str]) -> None:
    for f in functions:
        a.rule(f"{key}_no_{f}", R.MayNotCallFunction(layer, f))
    for c in _EXITS:
        a.rule(f"{key}_no_{c}", R.MayNotUseLanguageConstruct(layer, c))


@dataclass(frozen=True)
class Mvc:
    controller_complexity: int = 5
    controller_length: int = 20
    controller_dependencies: int = 5
    view_complexity: int = 3

    def __call__(self, a: Architecture) -> None:
        own = dict(a.layers)
        names = {"Controller": "Controllers?", "Model": "Models?", "View": "Views?", "Service": "Services?"}
        paths = {"Controller": ["src/Controller/", "src/Controllers/", "app/Controllers/", "app/Http/Controllers/"], "Model": ["src/Model/", "src/Models/", "app/Models/"], "View": ["src/View/"], "Service": ["src/Service/"]}
        for layer, name in names.items():
            if layer not in own and layer not in a.patterns:
                a.layer_pattern(layer, rf"/(?:^|\\){name}(?:\\|$)/", r"/(?:^|\\)[^\\]*Tests?(?:\\|$)/")
        for layer, found in paths.items():
            if layer not in own:
                a.layer(layer, found)
        for source, target in (("Model", "Controller"), ("Model", "View"), ("View", "Controller"), ("View", "Model")):
            a.rule(f"mvc.layer.{source.lower()}_not_depend_{target.lower()}", R.MayNotDependOn(source, target))
        c, m, v, s = "mvc.controller", "mvc.model", "mvc.view", "mvc.service"
        a.rule(f"{c}.name_must_end_with_controller", R.ClassNameMustHaveSuffix("Controller", "Controller")).rule(f"{c}.must_be_final", R.MustBeFinal("Controller", "/Controller$/"))
        a.rule(f"{c}.max_complexity", R.MaxCyclomaticComplexity("Controller", self.controller_complexity)).rule(f"{c}.max_method_length", R.MaxMethodLength("Controller", self.controller_length))
        a.rule(f"{c}.max_dependencies", R.MaxDependencyCount("Controller", self.controller_dependencies)).rule(f"{c}.no_pdo", R.MayNotUseClass("Controller", "PDO"))
        a.rule(f"{c}.no_doctrine_orm", R.MayNotUseNamespace("Controller", "Doctrine\\ORM\\")).rule(f"{c}.no_superglobals", R.MayNotUseSuperglobals("Controller"))
        a.rule(f"{c}.must_have_return_types", R.MustHaveReturnType("Controller"))
        a.rule(f"{m}.name_must_not_start_with_model", R.ClassNameMustNotHavePrefix("Model", "Model")).rule(f"{m}.no_echo", R.MayNotUseLanguageConstruct("Model", "echo"))
        a.rule(f"{m}.no_print", R.MayNotUseLanguageConstruct("Model", "print")).rule(f"{m}.no_header", R.MayNotCallFunction("Model", "header"))
        a.rule(f"{m}.no_superglobals", R.MayNotUseSuperglobals("Model")).rule(f"{m}.no_datetime", R.MayNotUseClass("Model", "DateTime")).rule(f"{m}.must_have_return_types", R.MustHaveReturnType("Model"))
        a.rule(f"{v}.max_complexity", R.MaxCyclomaticComplexity("View", self.view_complexity)).rule(f"{v}.no_pdo", R.MayNotUseClass("View", "PDO"))
        a.rule(f"{v}.no_doctrine_orm", R.MayNotUseNamespace("View", "Doctrine\\ORM\\")).rule(f"{v}.no_header", R.MayNotCallFunction("View", "header")).rule(f"{v}.no_superglobals", R.MayNotUseSuperglobals("View"))
        a.rule(f"{s}.must_be_final", R.MustBeFinal("Service", "/Service$/")).rule(f"{s}.no_echo", R.MayNotUseLanguageConstruct("Service", "echo")).rule(f"{s}.no_header", R.MayNotCallFunction("Service", "header"))
        a.rule(f"{s}.no_superglobals", R.MayNotUseSuperglobals("Service")).rule(f"{s}.must_have_return_types", R.MustHaveReturnType("Service"))
        for layer in names:
            _safety(a, f"mvc.safety.{layer.lower()}", layer, (*_DEBUG, "var_export"))
