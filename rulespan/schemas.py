"""Schemas of facts, violations and baselines, as DDL."""

METHOD = ("struct<name string, visibility string, has_return_type boolean, is_static boolean, param_count int, cyclomatic_complexity int, "
          "line_count int, has_explicit_visibility boolean, line int, is_magic boolean>")
CONSTANT = "struct<name string, visibility string, has_explicit_visibility boolean, line int>"
PROPERTY = "struct<name string, visibility string, has_explicit_visibility boolean, line int>"

CLASS_NODES = (
    "class_name string, file string, line int, layer string, layers array<string>, extends string, is_abstract boolean, is_final boolean, is_interface boolean, "
    "is_readonly boolean, is_trait boolean, is_enum boolean, dependencies array<string>, implements array<string>, interface_extends array<string>, traits array<string>, "
    f"methods array<{METHOD}>, constants array<{CONSTANT}>, properties array<{PROPERTY}>, function_calls array<string>, superglobals array<string>, language_constructs array<string>"
)
ANONYMOUS_CLASSES = "file string, line int, extends string, implements array<string>, traits array<string>"
FILE_REFERENCES = "file string, references array<string>"
#: ``keyword`` is null for a plain name, else self, static or parent of ``class_name``, to be resolved over all facts.
FILE_INSTANTIATIONS = "file string, targets array<struct<keyword string, class_name string>>"
FILE_ANALYSES = ("file string, has_utf8_bom boolean, has_valid_utf8 boolean, invalid_php_tag_line int, has_valid_ast boolean, declares_symbols boolean, "
                 "has_side_effects boolean, side_effect_line int")
VIOLATIONS = ("rule_key string, message string, file string, line int, class_name string, layer string, fixable boolean, method_name string, constant_name string, property_name string")
BASELINE = "rule string, message string, file string, class string, layer string"

#: What a fact is where a source doesn't tell.
NODE_DEFAULTS = {
    "line": "1", "layer": "CAST(NULL AS STRING)", "layers": "CAST(NULL AS ARRAY<STRING>)", "extends": "CAST(NULL AS STRING)",
    **dict.fromkeys(("is_abstract", "is_final", "is_interface", "is_readonly", "is_trait", "is_enum"), "false"),
    **dict.fromkeys(("dependencies", "implements", "interface_extends", "traits", "function_calls", "superglobals", "language_constructs"), "CAST(array() AS ARRAY<STRING>)"),
    "methods": f"CAST(array() AS ARRAY<{METHOD}>)", "constants": f"CAST(array() AS ARRAY<{CONSTANT}>)", "properties": f"CAST(array() AS ARRAY<{PROPERTY}>)",
}
