"""Ignore and attribute files against the version-control tool that defines them."""

import random
import re
import shutil
import subprocess

import pytest

from lodestone.functions import globs
from lodestone.operators import ignore

needs_git = pytest.mark.skipif(not shutil.which("git"), reason="no git")


def files(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def judged(spark, texts, paths):
    items = spark.createDataFrame([(p,) for p in paths], "path string").selectExpr("path", "1 AS directory", "'x' AS line", "2 AS level")
    return {r.path: (r.ignored, r.directory, r.line) for r in ignore.ignored(items, ignore.ignore_rules(files(spark, texts))).collect()}


def test_nested_order_and_negation(spark):
    texts = {
        ".gitignore": "# comment\n*.log\n!keep.log\n/build/\nnode_modules/\n\\#x\n\\!y\nsp\\ \ntrail   \n",
        "src/.gitignore": "!debug.log\n*.tmp\ngen/**/out\n",
        "src/deep/.gitignore": "debug.log\n!/a.tmp\n",
    }
    got = judged(spark, texts, ["a.log", "keep.log", "src/debug.log", "src/deep/debug.log", "src/deep/a.tmp", "src/deep/x/a.tmp", "src/b.tmp", "build/keep.log", "src/build/x", "x/node_modules/y/z", "node_modules", "node_modules/", "#x", "!y", "sp ", "trail", "src/gen/out", "src/gen/a/b/out", "gen/out", None, "", "/"])
    assert got["a.log"] == (True, "", 2) and got["keep.log"] == (False, "", 3)
    assert got["src/debug.log"] == (False, "src", 1) and got["src/deep/debug.log"] == (True, "src/deep", 1)
    assert got["src/deep/a.tmp"] == (False, "src/deep", 2) and got["src/deep/x/a.tmp"] == (True, "src", 2) == got["src/b.tmp"]
    assert got["build/keep.log"] == (True, "", 4), "nothing below an ignored directory comes back"
    assert got["src/build/x"] == (False, None, None) and got["x/node_modules/y/z"][0] and not got["node_modules"][0] and got["node_modules/"][0]
    assert got["#x"][0] and got["!y"][0] and got["sp "][0] and got["trail"][0]
    assert got["src/gen/out"][0] and got["src/gen/a/b/out"][0] and not got["gen/out"][0]
    assert got[None] == got[""] == got["/"] == (False, None, None)


NAMES = ["a", "b", "ab", "a.c", "b.c", "x.tar.gz", "[z]", "é", "A", "a-b", "a b", "1"]
PATTERNS = ["a", "/a", "a/", "*.c", "*.gz", "x.*", "a/b", "a/*", "a/**", "**/b", "a/**/b", "?", "[ab]", "[!a]", "[a-b].c", "*", "**", "/*", "!a", "!*.c", "!/a/", "!b/", "\\[z\\]", "[[:alpha:]]", "[[:upper:]]", "a?b", "a*", "*b", "é", "!**/b", "b/a/", "a\\-b", "[]a]", "[a", "a**b", "***", "x.tar.gz", "[^a-b]", "[b-a]", "!1", "*/a", "*/", "!*/"]


@needs_git
def test_against_git(spark, tmp_path):
    """Random trees and rules: every file's verdict and rule are those of the tool itself."""
    rng = random.Random(6)
    checked = 0
    for trial in range(6):
        root = tmp_path / str(trial)
        root.mkdir()
        subprocess.run(["git", "init", "-q", str(root)], check=True)
        paths = set()
        for _ in range(90):
            parts = [rng.choice(NAMES) for _ in range(rng.randrange(1, 5))]
            place = root.joinpath(*parts)
            try:
                place.parent.mkdir(parents=True, exist_ok=True)
                if not place.exists():
                    place.write_text("")
                    paths.add("/".join(parts))
            except OSError:
                continue  # a file stands where a directory should be
        folders = sorted({""} | {str(p.relative_to(root)) for p in root.rglob("*") if p.is_dir() and ".git" not in p.parts})
        texts = {}
        for folder in rng.sample(folders, min(len(folders), 8)) + [""]:
            text = "\n".join(rng.choices(PATTERNS, k=rng.randrange(1, 7))) + "\n"
            name = f"{folder}/.gitignore".lstrip("/")
            (root / name).write_text(text)
            texts[name] = text
        told = subprocess.run(["git", "-C", str(root), "-c", "core.quotepath=off", "check-ignore", "--no-index", "-v", "-n", "-z", "--stdin"], input="\0".join(sorted(paths)).encode(), capture_output=True).stdout.decode().split("\0")
        want = {}
        for source, line, pattern, path in zip(*[iter(told[:-1])] * 4, strict=True):
            want[path] = (bool(source) and not pattern.startswith("!"), source.rpartition("/")[0] if source else None, int(line) if line else None)
        got = judged(spark, texts, sorted(paths))
        assert got.keys() == want.keys()
        wrong = {p: (got[p], want[p]) for p in got if got[p][0] != want[p][0]}
        assert not wrong, (texts, wrong)
        # The tool names the rule of the directory that it stopped at, or of the path itself, as is done here.
        assert {p: g for p, g in got.items() if g[0]} == {p: g for p, g in want.items() if g[0]}
        checked += sum(g[0] for g in got.values())
    assert checked > 50


@needs_git
def test_attributes_against_git(spark, tmp_path):
    rng = random.Random(9)
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    values = ["filter=lfs", "-filter", "!filter", "filter=other", "filter", "text"]
    paths = sorted({"/".join(rng.choice(NAMES) for _ in range(rng.randrange(1, 5))) for _ in range(150)})
    texts = {}
    for folder in ["", "a", "a/b", "b", "ab/a"]:
        text = "# note\n" + "".join(f"{p} {rng.choice(values)}\n" for p in rng.choices([p for p in PATTERNS if not p.startswith("!") and " " not in p], k=8))
        name = f"{folder}/.gitattributes".lstrip("/")
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
        texts[name] = text
    told = subprocess.run(["git", "-C", str(tmp_path), "check-attr", "-z", "--stdin", "filter"], input="\0".join(paths).encode(), capture_output=True, check=True).stdout.decode().split("\0")
    want = {path: {"set": "true", "unset": "false"}.get(value, value) for path, _, value in zip(*[iter(told[:-1])] * 3, strict=True) if value != "unspecified"}
    items = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.value for r in ignore.attributes(items, ignore.attribute_rules(files(spark, texts), "filter")).collect()}
    assert got == want and len(got) > 30


def test_oversize_by_pattern(spark):
    rules = ignore.attribute_rules(files(spark, {".gitattributes": "data/*.sqlite3 filter=lfs diff=lfs -text\n*.bin filter=lfs\nsmall.bin -filter\n", "x/.gitattributes": "*.bin !filter\n"}), "filter")
    items = spark.createDataFrame([("data/a.sqlite3", 200), ("data/b/a.sqlite3", 200), ("a.bin", 200), ("x/a.bin", 200), ("small.bin", 200), ("tiny", 5), (None, 300), ("a.bin", 200), ("data/c", None)], "path string, n long")
    got = sorted((r.path or "", r.bytes) for r in ignore.oversize_by_pattern(items, rules, items.n, 100).collect())
    assert got == [("", 300), ("data/b/a.sqlite3", 200), ("small.bin", 200), ("x/a.bin", 200)]


def test_shuffled_rules_and_empty_tables(spark, monkeypatch):
    texts = {".gitignore": "*.c\n", "a/.gitignore": "!a.c\n"}
    want = judged(spark, texts, ["a/a.c", "b.c", "a/b.c", "z"])
    monkeypatch.setattr(ignore, "BROADCAST_BYTES", -1)
    assert judged(spark, texts, ["a/a.c", "b.c", "a/b.c", "z"]) == want
    none = files(spark, {"x": ""}).limit(0)
    assert ignore.ignored(none, ignore.ignore_rules(none)).collect() == []
    assert judged(spark, {".gitignore": None}, ["a"]) == {"a": (False, None, None)}


def test_keys_are_needed():
    """Whatever fits a pattern brings its key."""
    rng = random.Random(1)
    for pattern in PATTERNS:
        glob = globs.translate(pattern.removeprefix("!"))
        for _ in range(300):
            path = "/".join(rng.choice(NAMES) for _ in range(rng.randrange(1, 4)))
            name = path.rpartition("/")[2]
            keys = {"*", f"n:{name}"} | ({f"e:{name.rpartition('.')[2]}"} if "." in name else set())
            if glob and re.search(glob.regex.replace("\\z", "\\Z"), path):
                assert glob.key in keys, (pattern, path)
            elif glob and glob.sure:
                assert glob.key not in keys, (pattern, path)
