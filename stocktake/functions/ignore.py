"""Ignore rules: ordered patterns, the last match decides, what an ignored folder holds cannot be reopened."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import path_ancestors, path_name


@dataclass(frozen=True)
class Rule:
    regex: str
    keep: bool  # a pattern that began with '!'
    folders: bool  # a pattern that ended with '/'


def compile_rule(line: str) -> Rule | None:
    """One line of an ignore file; None for a blank line or a comment."""
    line = line.rstrip("\n")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    keep = line.startswith("!")
    line = line[1:] if keep else line
    line = line[1:] if line.startswith("\\") else line
    folders = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    parts = line.lstrip("/").split("/")
    out = "" if anchored else "(?:.*/)?"
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:.*/)?"
            continue
        body = ""
        for token in re.findall(r"\\.|\[!?[^\]]+\]|\*+|\?|.", part):
            if token[0] == "*":
                body += "[^/]*"
            elif token == "?":
                body += "[^/]"
            elif token[0] == "[" and len(token) > 1:
                body += "[^" + token[2:] if token[1] == "!" else token
            else:
                body += re.escape(token[-1])
        out += body + ("" if last else "/")
    return Rule("(?s)^" + out + r"\z", keep, folders)


def last_match(path: Column, is_folder: Column, rules: Sequence[Rule]) -> Column:
    """Whether the last rule that matches the path itself ignores it; false without a match."""
    if not rules:
        return F.lit(False)
    fits = [F.rlike(path, F.lit(r.regex)) & (is_folder if r.folders else F.lit(True)) for r in rules]
    out = F.lit(False)
    for fit, rule in zip(fits, rules):
        out = F.when(fit, F.lit(not rule.keep)).otherwise(out)
    return out


def ignored(path: Column, is_folder: Column, lines: Sequence[str]) -> Column:
    """Whether the path or a folder above it is ignored."""
    rules = [r for r in map(compile_rule, lines) if r]
    return last_match(path, is_folder, rules) | F.exists(path_ancestors(path), lambda a: last_match(a, F.lit(True), rules))


def ignored_selected(path: Column, lines: Sequence[str]) -> Column:
    """A file that is named explicitly is matched by its own name."""
    return last_match(path_name(path), F.lit(False), [r for r in map(compile_rule, lines) if r])


def matcher(lines: Sequence[str]) -> Callable[[str, bool], bool]:
    """last_match for readers, which meet one path at a time: (path, is_folder) is ignored by itself. Folders above are up to the reader, which does not descend into ignored ones."""
    rules = [(re.compile(r.regex.removesuffix(r"\z") + r"\Z"), r) for r in map(compile_rule, lines) if r]

    def ignores(path: str, is_folder: bool) -> bool:
        for regex, rule in reversed(rules):
            if (is_folder or not rule.folders) and regex.match(path):
                return not rule.keep
        return False

    return ignores


def _plain(part: str) -> bool:
    return not re.search(r"[*?\[\\]", part)


def rule_key(line: str) -> tuple[str, str]:
    """What an entry that the rule matches must have: its name, its extension, or the first component of its path; (any, '') where the rule has no such part."""
    body = re.sub(r"(?<!\\) +$", "", line.rstrip("\n")).removeprefix("!").rstrip("/")
    parts = body.lstrip("/").split("/")
    if "/" in body and _plain(parts[0]):
        return "first", parts[0]
    if _plain(parts[-1]):
        return "name", parts[-1]
    tail = re.split(r"[*?\]]", parts[-1])[-1]
    if parts[-1].endswith("*") or "\\" in parts[-1] or "." not in tail:
        return "any", ""
    return "ext", tail[tail.rindex(".") :]
