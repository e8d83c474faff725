"""Code expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.texts import trimmed

# Fixed values.
CODE_HOSTS = ("github.com", "gitlab.com", "gist.github.com", "raw.githubusercontent.com", "bitbucket.org")
SNIPPET_TITLE = r"(?i)^deep\s*dive\s*:"
FENCE = r"(?m)^```"
KEYWORDS = r"(?i)\b(def|class|import|from|return|elif|else|async|await|function|const|let|var|interface|struct|enum|namespace|SELECT|INSERT|UPDATE|DELETE|CREATE|WITH|public|private|protected|static|void|int|float|bool)\b"
CONTROL_LINE = r"(?im)^\s*(if|for|while|switch|case|try|catch)\s*[\(:]"
CODE_LINE_STARTS = ("    ", "\t")
CODE_BODY_STARTS = ("def ", "class ", "#", "//", "/*")
CODE_MARKS = r"=>|::|\+\+|--|\|\||&&"
CODE_SUFFIXES = (".py", ".js", ".ts", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".rb", ".sh", ".sql", ".ipynb")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def local_imports(code: Column | str, package: Column) -> Column:
    """Files that the relative imports and those of the package name."""
    relative = F.regexp_extract_all(_c(code), F.lit(r"(?m)^from\s+\.([A-Za-z_][\w.]*)\s+import"), F.lit(1))
    own = F.filter(F.regexp_extract_all(_c(code), F.lit(r"(?m)^(?:from|import)\s+([A-Za-z_][\w.]*)"), F.lit(1)), lambda m: m.startswith(F.concat(package, F.lit("."))))
    file = lambda m: F.concat(F.replace(m, F.lit("."), F.lit("/")), F.lit(".py"))
    return F.array_distinct(F.concat(F.transform(relative, lambda m: F.concat_ws("/", package, file(m))), F.transform(own, file)))


def is_code_source(url: Column | str, method: Column | None = None) -> Column:
    """First layer of the code detector: method, host or file suffix."""
    from tidewell.functions.urls import host, path, under

    out = under(host(url), CODE_HOSTS) | F.lower(path(url)).rlike("(" + "|".join(s.replace(".", r"\.") for s in CODE_SUFFIXES) + ")$")
    return out if method is None else out | F.coalesce(method == "github_tree", F.lit(False))


def is_likely_code(text: Column | str) -> Column:
    """Whether a snippet is code rather than a title or prose: fences, keywords, control lines, indents, marks."""
    raw = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(raw, r"\n?```$", ""), r"^\s+|\s+$", "")
    lines = F.filter(F.split(inner, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]"), lambda x: F.trim(x) != "")
    count = lambda c: F.length(inner) - F.length(F.replace(inner, F.lit(c), F.lit("")))
    holds = lambda x, c: F.contains(x, F.lit(c))
    body = lambda x: F.regexp_replace(x, r"^\s+", "")
    starts = lambda x: reduce(or_, [x.startswith(s) for s in CODE_LINE_STARTS] + [body(x).startswith(s) for s in CODE_BODY_STARTS])
    several = (F.size(lines) >= 2) & F.exists(lines, lambda x: starts(x) | holds(x, ";") | holds(x, "{") | holds(x, "}"))
    assigned = (holds(inner, ";") & (holds(inner, "=") | holds(inner, "("))) | ((count("(") >= 2) & (count(")") >= 2) & holds(inner, "="))
    sure = raw.rlike(FENCE) | inner.rlike(KEYWORDS) | inner.rlike(CONTROL_LINE) | several | assigned | inner.rlike(CODE_MARKS)
    return (F.length(raw) >= 4) & ~raw.rlike(SNIPPET_TITLE) & sure


def linear_chunks(text: Column | str, most: int = 1200, piece: int = 1000, least: int = 1) -> Column:
    """Blocks between blank lines; a longer one is cut into slices."""
    blocks = F.filter(F.transform(F.split(_c(text), r"\n\s*\n"), lambda b: trimmed(b)), lambda b: F.length(b) >= least)

    def sliced(b: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1)), F.lit(piece))
        return F.when(F.length(b) <= most, F.array(b)).otherwise(F.transform(starts, lambda i: F.substring(b, i, F.lit(piece))))

    return F.flatten(F.transform(blocks, sliced))
