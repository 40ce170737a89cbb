"""Built-in rules."""

from rulespan.rules.base import Facts, Rule
from rulespan.rules.class_rules import (
    ClassConstantNameMustBeUpperCase, ClassImplementingInterfaceMustHaveSuffix, ClassNameMustBeStudlyCaps, ClassNameMustHaveSuffix, ClassNameMustNotHavePrefix,
    ExtendedClassMustBeAbstractOrInstantiated, MaxDependencyCount, MayNotImplementInterface, MustBeFinal, MustBeInterface, MustBeUsedAbstractClass, MustBeUsedInterface,
    MustBeUsedTrait, MustDeclareConstantVisibility, MustDeclareMethodVisibility, MustDeclarePropertyVisibility, MustImplementInterface, NamingConvention,
)
from rulespan.rules.method_rules import MaxCyclomaticComplexity, MaxMethodLength, MethodNameMustBeCamelCase, MustHaveReturnType
from rulespan.rules.project_rules import (
    Psr1PhpTags, Psr1SymbolsOrSideEffects, Psr1Utf8WithoutBom, Psr1ValidUtf8, Psr4DirectoryExists, Psr4EmptyNamespacePrefix, Psr4Namespace, Psr4RootPath, Psr4SourcePaths,
)
from rulespan.rules.usage_rules import MayNotCallFunction, MayNotDependOn, MayNotUseClass, MayNotUseLanguageConstruct, MayNotUseNamespace, MayNotUseSuperglobals

__all__ = [name for name in dir() if name[0].isupper()]
