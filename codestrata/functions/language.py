"""Language classification as native column expressions.

A file name decides first, then its extension; the first line (``#!``) only
when the path says nothing, so path-only queries need not read content.
Extensions that several languages share are decided by weighted signs in the
content. Unknown is NULL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public names of languages with their usual file extensions.
LANGUAGE_EXTENSIONS: dict[str, tuple[str, ...]] = {
    "Assembly": ("asm",),
    "Batchfile": ("bat", "cmd"),
    "C": ("c", "h"),
    "C#": ("cs",),
    "C++": ("cpp", "cc", "cxx", "hpp", "hh", "hxx"),
    "CSS": ("css",),
    "Clojure": ("clj", "cljs"),
    "CoffeeScript": ("coffee",),
    "Dart": ("dart",),
    "Diff": ("diff", "patch"),
    "Dockerfile": ("dockerfile",),
    "Elixir": ("ex", "exs"),
    "Elm": ("elm",),
    "Erlang": ("erl", "hrl"),
    "F#": ("fs", "fsx"),
    "Fortran": ("f", "f90", "f95"),
    "Go": ("go",),
    "GraphQL": ("graphql",),
    "Groovy": ("groovy", "gradle"),
    "HTML": ("html", "htm", "xhtml"),
    "Haskell": ("hs",),
    "INI": ("ini", "cfg"),
    "JSON": ("json",),
    "Java": ("java",),
    "JavaScript": ("js", "mjs", "jsx"),
    "Julia": ("jl",),
    "Kotlin": ("kt", "kts"),
    "Less": ("less",),
    "Lua": ("lua",),
    "Makefile": ("mk",),
    "Markdown": ("md", "markdown"),
    "OCaml": ("ml", "mli"),
    "Objective-C": ("m",),
    "PHP": ("php",),
    "Pascal": ("pas",),
    "Perl": ("pl", "pm"),
    "PowerShell": ("ps1",),
    "Protocol Buffer": ("proto",),
    "Python": ("py", "pyw"),
    "R": ("r",),
    "Ruby": ("rb", "gemspec", "rake"),
    "Rust": ("rs",),
    "SCSS": ("scss",),
    "SQL": ("sql",),
    "SVG": ("svg",),
    "Scala": ("scala", "sbt"),
    "Shell": ("sh", "bash", "zsh", "ksh"),
    "Swift": ("swift",),
    "TOML": ("toml",),
    "TeX": ("tex",),
    "Text": ("txt",),
    "TypeScript": ("ts", "tsx"),
    "Visual Basic": ("vb",),
    "XML": ("xml", "xsd", "xsl"),
    "YAML": ("yml", "yaml"),
    "reStructuredText": ("rst",),
}

# Lower-cased file names that decide by themselves.
LANGUAGE_FILENAMES: dict[str, tuple[str, ...]] = {
    "CMake": ("cmakelists.txt",),
    "Dockerfile": ("dockerfile",),
    "Makefile": ("makefile", "gnumakefile"),
    "Ruby": ("gemfile", "rakefile"),
    "Text": ("license", "copying", "news", "install"),
}

# Programs named on a "#!" line.
LANGUAGE_INTERPRETERS: dict[str, tuple[str, ...]] = {
    "JavaScript": ("node", "nodejs"),
    "Lua": ("lua",),
    "PHP": ("php",),
    "Perl": ("perl",),
    "Python": ("python",),
    "R": ("rscript",),
    "Ruby": ("ruby",),
    "Shell": ("bash", "sh", "zsh", "ksh", "dash"),
}

# Languages that share an extension, with weighted signs of each in a text. The language
# with most weight has the file; the one named first, with equal weight. Patterns keep to
# what all regular-expression engines read alike: lines end with \\n, letters are ASCII.
_LINE = r"(^|\n)[ \t]*"
CONTENT_SIGNS: dict[str, dict[str, tuple[tuple[str, int], ...]]] = {
    "h": {
        "C": (),
        "C++": (
            (_LINE + r"(class|namespace|using)[ \t]+[A-Za-z_]", 3),
            (_LINE + r"template[ \t]*<", 3),
            (_LINE + r"(public|private|protected)[ \t]*:", 3),
            (r"std::[a-z_]|[^A-Za-z0-9_](constexpr|nullptr|virtual)[^A-Za-z0-9_]", 2),
        ),
        "Objective-C": (
            (_LINE + r"@(interface|protocol|property|class|end|import)[^A-Za-z0-9_]", 4),
            (_LINE + r"#[ \t]*import[ \t]", 3),
        ),
    },
    "m": {
        "Objective-C": (
            (_LINE + r"@(interface|implementation|property|protocol|end|import)[^A-Za-z0-9_]", 4),
            (_LINE + r"#[ \t]*(import|include|define)[ \t]", 3),
            (r"\[[A-Za-z_]+ [A-Za-z_]+[\]:]", 1),
        ),
        "MATLAB": (
            (_LINE + r"%", 2),
            (_LINE + r"function[ \t]+[\[A-Za-z]", 3),
            (_LINE + r"end[ \t]*;?[ \t]*\n", 1),
        ),
    },
    "pl": {
        "Perl": (
            (_LINE + r"(use|package|require)[ \t]+[A-Za-z0-9:_.]+[^;\n]*;", 3),
            (_LINE + r"(my|our)[ \t]*[($@%]", 3),
            (_LINE + r"sub[ \t]+[A-Za-z_]", 2),
        ),
        "Prolog": (
            (_LINE + r":-[ \t]*[a-z]", 4),
            (_LINE + r"[a-z][A-Za-z0-9_]*\([^()\n]*\)[ \t]*(:-|\.[ \t]*\n)", 3),
        ),
    },
    "ts": {
        "TypeScript": (
            (_LINE + r"(import|export|const|let|interface|type|enum|declare)[ \t{]", 1),
        ),
        "XML": (
            (r"^[ \t\n]*<(\?xml|!DOCTYPE TS|TS)[ >\t]", 3),
        ),
    },
}

# Classifier name (lower case) -> parser name, where they differ.
PARSER_ALIASES = {"shell": "bash", "c++": "cpp", "c#": "csharp"}

_INTERPRETER = r"^#!\s*(?:\S*/env\s+(?:-\S+\s+)*)?(?:\S*/)?([A-Za-z]+)"


def _names_sql(languages: dict[str, tuple[str, ...]]) -> str:
    pairs = [f"'{key}', '{name}'" for name, keys in languages.items() for key in keys]
    return f"map({', '.join(pairs)})"


def _extension_sql(path: str) -> str:
    name = f"substring_index(lower({path}), '/', -1)"
    return f"if(contains({name}, '.'), substring_index({name}, '.', -1), NULL)"


def _path_sql(path: str) -> str:
    name = f"substring_index(lower({path}), '/', -1)"
    by_name = f"try_element_at({_names_sql(LANGUAGE_FILENAMES)}, {name})"
    by_extension = f"try_element_at({_names_sql(LANGUAGE_EXTENSIONS)}, {_extension_sql(path)})"
    return f"coalesce({by_name}, {by_extension})"


def _signs_sql(extension: str, content: str) -> str:
    """The language of a shared extension; without content the one named first.

    The patterns stand in a lambda, which Spark calls. Their code would otherwise be part
    of the loop over all rows, and the JVM does not compile a loop of that length.
    """
    text = "sign_text"

    def weight(languages: tuple[tuple[str, int], ...]) -> str:
        return " + ".join(["0", *(f"if({text} RLIKE r'{sign}', {n}, 0)" for sign, n in languages)])

    cases = []
    for shared, languages in CONTENT_SIGNS.items():
        ranked = (
            f"struct({weight(signs)} AS weight, {-place} AS place, '{name}' AS name)"
            for place, (name, signs) in enumerate(languages.items())
        )
        cases.append(f"WHEN '{shared}' THEN array_max(array({', '.join(ranked)})).name")
    listed = ", ".join(f"'{shared}'" for shared in CONTENT_SIGNS)
    decided = f"transform(array(cast({content} AS string)), {text} -> CASE {extension} {' '.join(cases)} END)[0]"
    return f"if({extension} IN ({listed}), {decided}, NULL)"


def _content_sql(content: str) -> str:
    first = f"lower(regexp_extract(cast({content} AS string), r'{_INTERPRETER}', 1))"
    return f"try_element_at({_names_sql(LANGUAGE_INTERPRETERS)}, {first})"


def language_sql(path: str, content: str) -> str:
    """SQL expression for the language of a file; arguments are SQL expressions."""
    by_signs = _signs_sql(_extension_sql(path), content)
    return f"coalesce({by_signs}, {_path_sql(path)}, {_content_sql(content)})"


def _quoted(column: str) -> str:
    return f"`{re.sub('`', '``', column)}`"


def language_of_path(path: str = "file_path") -> Column:
    return F.expr(_path_sql(_quoted(path)))


def shared_extension(path: str = "file_path") -> Column:
    """The extension, where content has to decide between its languages; else NULL."""
    extension = _extension_sql(_quoted(path))
    listed = ", ".join(f"'{shared}'" for shared in CONTENT_SIGNS)
    return F.expr(f"if({extension} IN ({listed}), {extension}, NULL)")


def language_of_signs(extension: str, content: str = "blob_content") -> Column:
    return F.expr(_signs_sql(_quoted(extension), _quoted(content)))


def language_of_content(content: str = "blob_content") -> Column:
    return F.expr(_content_sql(_quoted(content)))


def language(path: str = "file_path", content: str = "blob_content") -> Column:
    """Language in display case, e.g. ``Java``."""
    return F.expr(language_sql(_quoted(path), _quoted(content)))


def classified(
    path: str = "file_path", content: str = "blob_content", override: Column | None = None
) -> Column:
    """Language in lower case; a given ``override`` takes the place of detection."""
    detected = language(path, content)
    if override is None:
        return F.lower(detected)
    given = F.when(override != "", override)
    return F.lower(F.coalesce(given, detected))


def parser_name(name: Column) -> Column:
    """Parser for a language name in any letter case."""
    lowered = F.lower(name)
    aliases = F.create_map(*[F.lit(v) for pair in PARSER_ALIASES.items() for v in pair])
    return F.coalesce(F.try_element_at(aliases, lowered), lowered)
