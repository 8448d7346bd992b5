"""Workspace configuration: suggested from module files, overridden by a user
file, then by the repository's own."""

from __future__ import annotations

import os
import re
from copy import deepcopy
from pathlib import Path

import yaml

REPO_FILE, USER_ENV = ".ferngraph.yml", "FERNGRAPH_USER_CONFIG"

#: All settings with their unset values.
EMPTY: dict = {
    "version": 1,
    "workspace": {"mode": "", "root": ""},
    "modules": [],
    "package_patterns": [],
    "output": {"limit": 0, "max_items": 0, "chunk_size": 0, "summary": False},
    "boundaries": [],
    "complexity": {"min_cyclomatic": 0, "min_cognitive": 0, "sort_by": "", "include_packages": False},
    "lifecycle": {"dedupe_mode": "", "max_hops": 0},
    "cache": {"capacity": 0},
}


class ConfigError(ValueError):
    """A configuration file that can't be read or written."""


def split_patterns(text: str) -> list[str]:
    """Patterns between commas and line ends, trimmed, each once; all packages
    if there are none."""
    found = [p.strip() for p in re.split("[,\n\r\t]", text)]
    return list(dict.fromkeys(p for p in found if p)) or ["./..."]


def merge_patterns(listed: list[str], single: str, config: dict) -> list[str]:
    given = ",".join([*listed, single]).strip(",")
    return split_patterns(given) if given.strip(" ,\n\r\t") else list(config["package_patterns"]) or ["./..."]


def merge(base: dict, over: dict) -> dict:
    """base with what `over` sets: numbers above 0, texts and lists that aren't
    empty; switches can only be turned on."""
    out = deepcopy(base)
    for k, v in (over or {}).items():
        if isinstance(v, dict):
            out[k] = merge(out.get(k) or {}, v)
        elif isinstance(v, bool):
            out[k] = bool(out.get(k)) or v
        elif isinstance(v, (int, float)):
            out[k] = v if v > 0 else out.get(k, 0)
        elif v:
            out[k] = deepcopy(v)
    return out


def normalized(config: dict) -> dict:
    """Version 1, clean lists, named modules, and all packages by default."""
    out = merge(EMPTY, config)
    out["version"] = 1
    out["package_patterns"] = list(dict.fromkeys(p.strip() for p in out["package_patterns"] if p and p.strip())) or ["./..."]
    for m in out["modules"]:
        m["root"] = (m.get("root") or ".").strip().rstrip("/") or "."
        m["name"] = m.get("name") or m.get("path") or m["root"]
    return out


def module_path(folder: Path) -> str:
    file = folder / "go.mod"
    for line in file.read_text().splitlines() if file.is_file() else []:
        if m := re.match(r"\s*module\s+(\S+)", line):
            return m[1].strip('"')
    return ""


def workspace_folders(file: Path) -> list[str]:
    """Folders that a workspace file uses, one to a line or in a block; the
    folder of the file itself is left out."""
    out, inside = [], False
    for line in file.read_text().splitlines():
        words = line.split("//")[0].split()
        if not words or words[0] in ("go", "toolchain", "replace"):
            continue
        if words[0] == "use":
            inside = "(" in words
            words = [w for w in words[1:] if w not in ("(", ")")]
        elif words[0] == ")":
            inside = False
            continue
        out += [w.strip('"').removeprefix("./").rstrip("/") for w in words[:1]]
    return [p for p in dict.fromkeys(out) if p and p != "."]


def suggest(root: str) -> dict:
    """From a workspace file, else a module file, else all packages."""
    top = Path(root)
    if (top / "go.work").is_file():
        folders = [f for f in workspace_folders(top / "go.work") if (top / f).is_dir()]
        own = [("", module_path(top))] if (top / "go.mod").is_file() else []
        mods = own + [(f, module_path(top / f)) for f in folders]
        return normalized({"workspace": {"mode": "workspace"}, "modules": [{"root": f or ".", "path": p} for f, p in mods], "package_patterns": [f"./{f}/..." if f else "./..." for f, _ in mods]})
    if path := module_path(top):
        return normalized({"workspace": {"mode": "module"}, "modules": [{"root": ".", "path": path}], "package_patterns": ["./..."]})
    return normalized({"workspace": {"mode": "auto"}})


def load(path: str | os.PathLike | None) -> dict:
    """A configuration file; empty if it is missing."""
    if not path or not Path(path).is_file():
        return {}
    try:
        got = yaml.safe_load(Path(path).read_text()) or {}
    except yaml.YAMLError as e:
        raise ConfigError(f"parse {path}: {e}") from e
    if not isinstance(got, dict):
        raise ConfigError(f"parse {path}: not a mapping")
    return got


def user_path() -> str:
    """The user's file; the environment can move it or turn it off."""
    given = os.environ.get(USER_ENV)
    if given is not None:
        given = given.strip()
        return "" if given.lower() in ("", "off", "none") else given
    return str(Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "ferngraph" / "config.yml")


def effective(root: str) -> dict:
    """Suggested, then user, then repository; normalised last, so a file that
    names no patterns keeps the detected ones."""
    return normalized(merge(merge(suggest(root), load(user_path())), load(Path(root) / REPO_FILE)))


def inspect(root: str) -> dict:
    repo, user = Path(root) / REPO_FILE, user_path()
    sources = [name for name, p in (("user", user), ("repo", repo)) if p and Path(p).is_file()]
    notes = [] if "repo" in sources else [f"no {REPO_FILE} found; defaults are detected"]
    return {"root": str(root), "repo_config": str(repo), "user_config": user, "sources": ["suggested", *sources], "effective": effective(root), "notes": notes, "next_step": "" if "repo" in sources else "init_workspace_config writes the suggestion"}


def marshal(config: dict) -> str:
    return yaml.safe_dump(normalized(config), sort_keys=False, allow_unicode=True)


def init(root: str, overwrite: bool = False) -> dict:
    """Write the suggestion; an existing file is replaced only if asked for."""
    path = Path(root) / REPO_FILE
    existed, config = path.exists(), suggest(root)
    try:
        with open(path, "w" if overwrite else "x", encoding="utf-8") as f:
            f.write(marshal(config))
    except FileExistsError as e:
        raise ConfigError(f"{path} exists; pass overwrite=True to replace it") from e
    return {"config_path": str(path), "created": not existed, "overwritten": existed and overwrite, "config": config}


def module_pairs(config: dict) -> list[tuple[str, str]]:
    return [("" if m["root"] == "." else m["root"], m.get("path", "")) for m in config["modules"]] or [("", "")]
