"""Rules as a table against a plain matcher: thousands of rules, several folders, the last match decides."""

import random

import pytest

from stocktake.functions.ignore import compile_rule, matcher, rule_key
from stocktake.operators import rules as R

RULES = "folder string, ordinal long, line string"


def kept_brute(paths, rules):
    """(path, kind) that are left; rules: (folder, ordinal, line)."""
    by_name = [(f or "", matcher([line]), compile_rule(line)) for f, _, line in sorted(rules, key=lambda r: r[1]) if compile_rule(line or "")]

    def ignored(path, is_folder):
        out = False
        for folder, hits, rule in by_name:
            if folder and not path.startswith(f"{folder}/"):
                continue
            inner = path[len(folder) + 1 :] if folder else path
            # a rule that keeps never ignores: it is asked whether it matches by turning it round
            if hits(inner, is_folder) if not rule.keep else matcher_of(rule)(inner, is_folder):
                out = not rule.keep
        return out

    def gone(path, is_folder):
        parts = path.split("/")
        return ignored(path, is_folder) or any(ignored("/".join(parts[:i]), True) for i in range(1, len(parts)))

    return sorted((p, k) for p, k in paths if not gone(p, k == "dir"))


def matcher_of(rule):
    import re

    regex = re.compile(rule.regex.removesuffix(r"\z") + r"\Z")
    return lambda path, is_folder: (is_folder or not rule.folders) and bool(regex.match(path))


def inventory(seed, n):
    r = random.Random(seed)
    names = ["a", "b", "logs", "keep", "x.tmp", "y.tar.gz", "n1", "n2", "lib", "é.o", "!k", "#c", "src"]
    paths = sorted({"/".join(r.choice(names) for _ in range(r.randint(1, 5))) for _ in range(n)})
    return [(p, "dir" if any(q.startswith(f"{p}/") for q in paths) else r.choice(["dir", "file", "file"])) for p in paths]


def check(spark, paths, rules):
    df = spark.createDataFrame([(*p, i) for i, p in enumerate(paths)], "path string, kind string, n int").repartition(3)
    got = R.without_ignored(df, spark.createDataFrame(rules, RULES))
    assert got.columns == df.columns
    assert sorted((r.path, r.kind) for r in got.collect()) == kept_brute(paths, rules)


def test_lines_of_every_kind(spark):
    lines = ["*.tmp", "/a/", "b/*", "!b/keep", "logs/", "!logs/", "**/n1", "src/**", "n[12]", "!n2", "lib/**/x.tmp", "*", "!a", "# no", "", "\\!k", "\\#c", "y.*", "*.gz ", "?", "!*.o"]
    for k in (9, 16, len(lines)):
        check(spark, inventory(1, 300), [("", i, x) for i, x in enumerate(lines[:k]) if x != "*" or k == len(lines)])


def test_rules_apply_below_their_folder_only(spark):
    check(spark, inventory(2, 400), [("a", 1, "/logs"), ("a/b", 2, "*.tmp"), (None, 3, "keep/"), ("logs", 4, "!keep/"), ("src", 5, "lib/n1"), ("a", 0, "src/")])


def test_thousands_of_rules_from_several_folders(spark):
    r = random.Random(5)
    parts = ["a", "b", "logs", "keep", "*.tmp", "n?", "*.gz", "x*", "src", "**", "[ab]", "lib", "none1", "none2", "q.zip"]
    folders = ["", "", "a", "a/b", "logs", "src/lib", "nowhere"]
    line = lambda: r.choice(["", "", "!"]) + r.choice(["", "/"]) + "/".join(r.choice(parts) if r.random() < 0.5 else f"only{r.randint(0, 999)}" for _ in range(r.choice([1, 1, 2, 3]))) + r.choice(["", "", "/"])
    found = [(r.choice(folders), i, line()) for i in range(2000)]
    check(spark, inventory(3, 250), [(f, i, x) for f, i, x in found if x.strip("!/") not in ("**", "x*", "n?", "[ab]", "a", "b")])


@pytest.mark.parametrize("named", [0, 1000])
def test_more_folders_than_are_named(spark, monkeypatch, named):
    monkeypatch.setattr(R, "NAMED_FOLDERS", named)
    check(spark, inventory(4, 200), [("a", 1, "logs"), ("b", 2, "*.tmp"), ("", 3, "n1")])


def test_no_rules_and_keys(spark):
    check(spark, inventory(6, 50), [])
    check(spark, inventory(6, 50), [("", 1, "# only a comment"), ("", 2, "  ")])
    keys = {"foo": ("name", "foo"), "/foo/": ("first", "foo"), "foo/*.c": ("first", "foo"), "*.tar.gz": ("ext", ".gz"), "a*": ("any", ""), "**/x": ("name", "x"), "*/b?.c": ("ext", ".c"), "!keep": ("name", "keep"), "[.]x": ("any", ""), "a\\*.b": ("any", "")}
    assert {x: rule_key(x) for x in keys} == keys
