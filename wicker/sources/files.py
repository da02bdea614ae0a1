"""Files of a repository: inventory, what to skip, binary content, languages."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicker.functions.text import base_name, extension

MAX_SIZE, SNIFF, SHEBANG = 2 << 20, 8192, 256
#: Files whose content is in memory together.
READ = 50

#: Folders, endings and name parts of generated or binary files.
GENERATED_DIRS = [
    ".hg", ".svn", ".worktrees", ".idea", ".vs", ".vscode", ".eclipse", ".claude", ".cache", ".eggs", ".mypy_cache",
    ".nox", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "__pycache__", "htmlcov", "site-packages", "venv",
    ".npm", ".nyc_output", ".pnpm-store", ".yarn", "bower_components", "coverage", "node_modules", ".next", ".nuxt",
    ".svelte-kit", ".angular", ".turbo", ".parcel-cache", ".docusaurus", ".expo", "dist", "obj", "Pods", ".terraform",
    ".serverless", "bazel-bin", "bazel-out", "bazel-testlogs", "build", ".cargo", ".stack-work", ".dart_tool",
    "zig-cache", "zig-out", ".metals", ".bloop", ".bsp", ".ccls-cache", ".clangd", "elm-stuff", "_opam", ".cpcache",
    ".shadow-cljs", ".vercel", ".netlify", ".qdrant_code_embeddings", "vendor", "vendored",
]
IGNORED_SUFFIXES = [
    ".tmp", "~", ".swp", ".bak", ".orig", ".pyc", ".pyo", ".o", ".a", ".so", ".dll", ".dylib", ".class", ".wasm",
    ".node", ".exe", ".rlib", ".elc", ".beam", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".bmp", ".tiff", ".webp",
    ".svg", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".bin", ".dat", ".db", ".sqlite", ".sqlite3", ".parquet",
    ".avro", ".pb", ".zip", ".tar", ".gz", ".bz2", ".xz", ".rar", ".7z", ".jar", ".war", ".ear", ".min.js",
    ".min.css", ".map", ".pem", ".crt", ".key", ".cer", ".p12",
]
GENERATED_PARTS = [
    ".d.ts", ".bundle.", ".chunk.", ".generated.", ".pb.go", "_pb2.py", ".pb2.py", "_grpc.pb.go",
]

#: Languages by file name, by ending and by interpreter.
BY_NAME = {
    "CMakeLists.txt": "CMake", "Dockerfile": "Dockerfile", "GNUmakefile": "Makefile", "Makefile": "Makefile", "makefile": "Makefile",
    "meson.build": "Meson", "meson.options": "Meson", "meson_options.txt": "Meson", "kustomization.yaml": "Kustomize", "kustomization.yml": "Kustomize",
    ".zshrc": "Zsh", ".zshenv": "Zsh", ".zprofile": "Zsh", "justfile": "Just", "Justfile": "Just", ".justfile": "Just",
    "BUILD": "Starlark", "BUILD.bazel": "Starlark", "WORKSPACE": "Starlark", "WORKSPACE.bazel": "Starlark",
    "requirements.txt": "Requirements", "requirements-dev.txt": "Requirements", "requirements-test.txt": "Requirements", "go.mod": "GoMod", ".env": "Dotenv", ".env.local": "Dotenv",
}
BY_ENDING = {
    "bash": "Bash", "bzl": "Starlark", "c": "C", "cc": "Cpp", "ccm": "Cpp", "cfg": "Ini", "cjs": "JavaScript",
    "clj": "Clojure", "cljc": "Clojure", "cljs": "Clojure", "cmake": "CMake", "conf": "Ini", "cpp": "Cpp",
    "cppm": "Cpp", "cs": "CSharp", "css": "Css", "cts": "TypeScript", "cxx": "Cpp", "dart": "Dart",
    "dockerfile": "Dockerfile", "elm": "Elm", "env": "Dotenv", "erl": "Erlang", "ex": "Elixir", "exs": "Elixir",
    "f03": "Fortran", "f08": "Fortran", "f90": "Fortran", "f95": "Fortran", "fs": "FSharp", "fsi": "FSharp",
    "fsx": "FSharp", "gemspec": "Ruby", "go": "Go", "gql": "GraphQl", "gradle": "Groovy", "graphql": "GraphQl",
    "groovy": "Groovy", "h": "Cpp", "hcl": "Hcl", "hh": "Cpp", "hpp": "Cpp", "hs": "Haskell", "htm": "Html",
    "html": "Html", "hxx": "Cpp", "ini": "Ini", "ixx": "Cpp", "java": "Java", "jl": "Julia", "js": "JavaScript",
    "json": "Json", "jsx": "JavaScript", "just": "Just", "justfile": "Just", "kt": "Kotlin", "kts": "Kotlin",
    "lua": "Lua", "m": "Matlab", "matlab": "Matlab", "md": "Markdown", "mdx": "Markdown", "meson": "Meson",
    "mjs": "JavaScript", "mk": "Makefile", "ml": "OCaml", "mli": "OCaml", "mlx": "Matlab", "mts": "TypeScript",
    "nix": "Nix", "php": "Php", "pl": "Perl", "pm": "Perl", "proto": "Protobuf", "py": "Python", "r": "R",
    "rake": "Ruby", "rb": "Ruby", "rs": "Rust", "sc": "Scala", "scala": "Scala", "scss": "Scss", "sh": "Bash",
    "sql": "Sql", "star": "Starlark", "svelte": "Svelte", "svg": "Xml", "swift": "Swift", "tf": "Hcl", "toml": "Toml",
    "ts": "TypeScript", "tsx": "Tsx", "vue": "Vue", "xml": "Xml", "xsd": "Xml", "xsl": "Xml", "yaml": "Yaml",
    "yml": "Yaml", "zsh": "Zsh",
}
BY_INTERPRETER = {
    "ash": "Bash", "bash": "Bash", "bun": "JavaScript", "dash": "Bash", "deno": "JavaScript", "fish": "Bash",
    "groovy": "Groovy", "julia": "Julia", "ksh": "Bash", "lua": "Lua", "luajit": "Lua", "node": "JavaScript",
    "nodejs": "JavaScript", "perl": "Perl", "php": "Php", "py": "Python", "pypy": "Python", "python": "Python",
    "python_": "Python", "r": "R", "rscript": "R", "ruby": "Ruby", "sh": "Bash", "zsh": "Zsh",
}
#: Endings whose parser differs from the language shown.
PARSERS = {"h": "C", "zig": "Zig"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    """A fixed table as a map literal."""
    return F.try_element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), key)


def language(path: Column) -> Column:
    """By the whole file name, else by its ending in lower case; null for neither."""
    return F.coalesce(_lookup(BY_NAME, base_name(path)), _lookup(BY_ENDING, F.lower(extension(path))))


def shebang_language(head: Column) -> Column:
    """By the interpreter in a first line that starts with ``#!``; versions, env, its flags and settings don't count."""
    line = F.regexp_extract(head, r"^#!([^\n\r]*)", 1)
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")
    first = base_name(F.get(words, F.lit(0)))
    rest = F.filter(F.slice(words, 2, 1000), lambda w: ~w.startswith("-") & ~w.contains("="))
    program = F.when(first == "env", base_name(F.get(rest, F.lit(0)))).otherwise(first)
    return _lookup(BY_INTERPRETER, F.lower(F.regexp_extract(program, "^([A-Za-z_-]*)", 1)))


def parser_language(path: Column) -> Column:
    ending = F.lower(extension(path))
    return F.coalesce(_lookup(PARSERS, ending), _lookup(BY_ENDING, ending))


def skip_reason(path: Column, size: Column, max_size: int | None = MAX_SIZE) -> Column:
    """Why a file is left out, or null: its folder, ending, name or size."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    name = F.lower(base_name(path))
    ends = F.exists(F.array(*map(F.lit, IGNORED_SUFFIXES)), lambda s: name.endswith(s))
    part = F.exists(F.array(*map(F.lit, GENERATED_PARTS)), lambda s: name.contains(s))
    out = F.when(F.arrays_overlap(folders, F.array(*map(F.lit, GENERATED_DIRS))), "folder").when(ends, "suffix").when(part, "pattern")
    return out if max_size is None else out.when(size > max_size, "size")


@F.pandas_udf(T.BooleanType())
def is_binary(content: pd.Series) -> pd.Series:
    """A NUL, or bytes that are not UTF-8, among the first 8 KiB; a character cut off at the end is fine."""

    def check(data: bytes | None) -> bool:
        head = bytes(data or b"")[:SNIFF]
        if b"\0" in head:
            return True
        try:
            head.decode("utf-8")
        except UnicodeDecodeError as e:
            return not (len(data) > SNIFF and e.start >= len(head) - 3 and e.reason == "unexpected end of data")
        return False

    return content.map(check)


def _glob(glob: str) -> str:
    """A regular expression: ``**`` crosses folders, ``*`` and ``?`` don't; brackets are a choice of characters."""
    out, i = "", 0
    while i < len(glob):
        end = glob.find("]", i + 2) if glob[i] == "[" else -1
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif end > 0:
            inside = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + ("[^/" + inside[1:] if inside[0] in "!^" else "[" + inside) + "]", end + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return out


def glob_pattern(glob: str) -> str:
    """As ``_glob``; a folder covers what is in it."""
    return f"^{_glob(glob.rstrip('/'))}(?:/.*)?$"


#: A rule of an ignore file: whether it lets in again, whether it holds for folders only, and its pattern.
Rule = tuple[bool, bool, str]


def ignore_rules(text: str) -> list[Rule]:
    """The rules of an ignore file: ``#`` remarks, ``!`` lets in again, a ``/`` at the end means folders, one before it anchors."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if line and not line.startswith("#"):
            again, line = line.startswith("!"), line.removeprefix("!")
            folder, line = line.endswith("/"), line.rstrip("/")
            anchored, line = "/" in line, line.removeprefix("/")
            if line:
                out.append((again, folder, f"^{'' if anchored else '(?:.*/)?'}{_glob(line)}$"))
    return out


def is_ignored(path: str, rules: dict[str, list[Rule]], is_folder: bool = False) -> bool:
    """Whether a path is hidden or ignored, by the rules of each folder (relative, "" the root): the last that matches decides.

    What lies in an ignored folder cannot be let in again.
    """
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        now, out = "/".join(parts[:n]), parts[n - 1].startswith(".")
        for above in range(n):
            folder = "/".join(parts[:above])
            for again, only_folders, pattern in rules.get(folder, ()):
                if (n < len(parts) or is_folder or not only_folders) and re.match(pattern, now[len(folder) + 1 if folder else 0 :]):
                    out = not again
        if out:
            return True
    return False


def overridden(path: Column, globs: list[str]) -> Column:
    """Whether ordered globs let a path in: the last that matches decides, ``!`` leaves out; without includes all are in."""
    out = F.lit(all(g.startswith("!") for g in globs))
    for g in globs:
        out = F.when(path.rlike(glob_pattern(g.removeprefix("!"))), not g.startswith("!")).otherwise(out)
    return out


def scope_key(globs: list[str]) -> str:
    return "\n".join(globs)


def repo_root(path: str) -> str:
    """The nearest folder up that has a ``.git``; the path itself if none has."""
    now = os.path.abspath(path)
    while not os.path.exists(os.path.join(now, ".git")):
        if (up := os.path.dirname(now)) == now:
            return os.path.abspath(path)
        now = up
    return now


def mounted(folder: str) -> str:
    """The path of a folder of the local file system, be it named with a scheme or not; fails on any other file system."""
    scheme, path = re.match(r"(?:([A-Za-z][\w+.-]*):)?(.*)", folder).groups()
    if scheme not in (None, "file"):
        raise RuntimeError(f"{folder} is not mounted as a folder")
    return os.path.abspath(re.sub("^/+", "/", path))


def listed(root: str) -> list[str]:
    """The relative paths of a local tree in order, without hidden files, links and what ignore files leave out.

    An ignored folder is not looked into. Folders that cannot be read are left out.
    """
    rules: dict[str, list[Rule]] = {}
    out, todo = [], [""]
    while todo:
        folder = todo.pop()
        try:
            entries = list(os.scandir(os.path.join(root, folder)))
        except OSError:
            continue
        for name in (".gitignore", ".ignore"):
            if any(e.name == name and e.is_file(follow_symlinks=False) for e in entries):
                with open(os.path.join(root, folder, name), encoding="utf-8", errors="replace") as f:
                    rules.setdefault(folder, []).extend(ignore_rules(f.read()))
        for e in entries:
            path = f"{folder}/{e.name}".removeprefix("/")
            inner = e.is_dir(follow_symlinks=False)
            if not e.is_symlink() and not is_ignored(path, rules, inner):
                if inner:
                    todo.append(path)
                elif e.is_file(follow_symlinks=False):
                    out.append(path)
    return sorted(out)


def stable_read(path: str, tries: int = 3) -> tuple[int, int, bytes] | None:
    """Size, time and content of a file that did not change while it was read; None if it always did or is gone."""
    for _ in range(tries):
        try:
            before = os.stat(path)
            with open(path, "rb") as f:
                content = f.read()
            after = os.stat(path)
        except OSError:
            return None
        if (before.st_size, before.st_mtime_ns, before.st_ino) == (after.st_size, after.st_mtime_ns, after.st_ino) and len(content) == after.st_size:
            return after.st_size, after.st_mtime_ns, content
    return None


def walk(spark: SparkSession, root: str, globs: list[str] | None = None, max_size: int | None = MAX_SIZE) -> DataFrame:
    """Inventory below a root: path, size, time, content, digest, skip reason, language and whether it is binary.

    A local tree is listed on the driver by its names alone (see ``listed``), and
    its files are read by the workers, which must see it under the same path. A
    root with a scheme is read by Spark's own file source, which knows no ignore
    files and leaves out names that begin with a dot or an underscore.
    """
    if "://" in root:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        rel = F.replace(F.col("path"), F.lit(root.rstrip("/") + "/"), F.lit(""))
        rows = files.select(rel.alias("rel_path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")
    else:
        top = os.path.abspath(root.removeprefix("file:"))

        def read(batches):
            for batch in batches:
                for at in range(0, len(batch), READ):
                    found = [(p, x) for p in batch["rel_path"].iloc[at : at + READ] if (x := stable_read(os.path.join(top, p)))]
                    yield pd.DataFrame([(p, *x) for p, x in found], columns=["rel_path", "size", "mtime_ns", "content"])

        paths = spark.createDataFrame([(p,) for p in listed(top)], "rel_path string")
        rows = paths.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(read, "rel_path string, size long, mtime_ns long, content binary")
    if globs:
        rows = rows.filter(overridden(F.col("rel_path"), globs))
    head = F.decode(F.substring("content", 1, SHEBANG), "ISO-8859-1")
    return rows.withColumns({
        "sha256": F.sha2("content", 256),
        "skip": skip_reason(F.col("rel_path"), F.col("size"), max_size),
        "language": F.coalesce(language(F.col("rel_path")), shebang_language(head)),
        "binary": is_binary(F.col("content")),
    })
