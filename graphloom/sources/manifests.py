"""Packages, dependencies and resources from manifests."""

from __future__ import annotations

import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from graphloom.sources.facts import Fact

ANDROID = "{http://schemas.android.com/apk/res/android}"


def _requirement(value) -> tuple[str | None, dict[str, str]]:
    if isinstance(value, str):
        return value, {}
    return value.get("version"), {"workspace": str(bool(value.get("workspace"))).lower(), "features": ",".join(value.get("features", []))}


def cargo(path: str, text: str) -> Iterator[Fact]:
    """``Cargo.toml``: the package, workspace members and dependencies; ``Cargo.lock`` style tables: locked versions."""
    data = tomllib.loads(text)
    owner = data["package"].get("name", "") if isinstance(data.get("package"), dict) else ""
    if owner:
        version = data["package"].get("version", "")
        yield Fact("package", owner, path, "cargo", version if isinstance(version, str) else "workspace")
    for p in data["package"] if isinstance(data.get("package"), list) else []:
        yield Fact("package", p.get("name", ""), path, "locked", p.get("version"))
    for m in data.get("workspace", {}).get("members", []):
        yield Fact("package", m, path, "member")
    parts = {"dependencies": "", "dev-dependencies": "dev", "build-dependencies": "build"}
    tables = [(t.get(key, {}), kind) for t in (data, *data.get("target", {}).values()) for key, kind in parts.items()]
    for table, kind in [*tables, (data.get("workspace", {}).get("dependencies", {}), "workspace")]:
        for name, value in table.items():
            requirement, detail = _requirement(value)
            yield Fact("dependency", name, owner or path, kind, requirement, detail=detail)


def fsproj(path: str, text: str) -> Iterator[Fact]:
    root = ET.fromstring(text)
    name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    yield Fact("package", name, path, "fsharp", next((x.text for x in root.iter() if x.tag.endswith("TargetFramework")), None))
    for x in root.iter():
        tag = x.tag.rsplit("}", 1)[-1]
        if tag in ("PackageReference", "ProjectReference") and "Include" in x.attrib:
            yield Fact("dependency", x.attrib["Include"], name, "package" if tag[1] == "a" else "project", x.attrib.get("Version"))


def solution(text: str) -> list[str]:
    """Project paths of a solution file, with forward slashes."""
    return [m.replace("\\", "/") for m in re.findall(r'^Project\([^)]*\)\s*=\s*"[^"]*",\s*"([^"]+\.\w+proj)"', text, re.M)]


def paket(text: str) -> dict[str, str]:
    return {m[1]: (m[2] or "").strip() for m in re.finditer(r"^\s*nuget\s+(\S+)[ \t]*(.*)$", text, re.M)}


def paket_references(text: str) -> list[str]:
    """Names that a project takes from the list above it, one a line, without groups and settings."""
    return [m[1] for m in re.finditer(r"^[ \t]*(?!group\b|//|#)([A-Za-z][\w.\-]*)", text, re.M)]


def gradle(path: str, text: str) -> Iterator[Fact]:
    name = path.rsplit("/", 2)[-2] if "/" in path else path
    yield Fact("package", name, path, "gradle", (m := re.search(r"jvmTarget\s*=\s*['\"]([^'\"]+)", text)) and m[1], detail={"generated": ",".join(re.findall(r"srcDirs?\(?\s*['\"]([^'\"]*generated[^'\"]*)['\"]", text))})
    for m in re.finditer(r"\b(implementation|api|ksp|kapt|testImplementation|compileOnly|runtimeOnly)\s*\(?\s*(project\(\s*)?['\"]([^'\"]+)['\"]", text):
        parts = m[3].split(":")
        yield Fact("dependency", m[3] if m[2] else ":".join(parts[:2]), name, "project" if m[2] else m[1], parts[2] if len(parts) > 2 and not m[2] else None)


def pom(path: str, text: str) -> Iterator[Fact]:
    root = ET.fromstring(re.sub(r'\sxmlns="[^"]*"', "", text, count=1))
    name = root.findtext("artifactId", "")
    yield Fact("package", name, path, "maven", root.findtext("version"))
    for d in root.iterfind("dependencies/dependency"):
        yield Fact("dependency", f"{d.findtext('groupId')}:{d.findtext('artifactId')}", name, d.findtext("scope", "compile"), d.findtext("version"))


def swift_package(path: str, text: str) -> Iterator[Fact]:
    name = (m := re.search(r'Package\(\s*name:\s*"([^"]+)"', text)) and m[1] or path
    yield Fact("package", name, path, "swift", (m := re.search(r"swift-tools-version:\s*([\d.]+)", text)) and m[1])
    for m in re.finditer(r'\.package\(\s*(?:name:\s*"[^"]*",\s*)?(url|path):\s*"([^"]+)"(?:\s*,\s*(?:from:|exact:|\.upToNextMajor\(from:)?\s*"([^"]+)")?', text):
        yield Fact("dependency", m[2].rstrip("/").rsplit("/", 1)[-1].removesuffix(".git"), name, m[1], m[3])


def android(path: str, text: str) -> Iterator[Fact]:
    """Manifest components, layouts, navigation graphs and values, by the file's name and folder."""
    root = ET.fromstring(text)
    folder = path.rsplit("/", 2)[-2].split("-")[0] if "/" in path else ""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    own = f"R.{folder}.{stem}"
    if stem == "AndroidManifest":
        for x in root.iter():
            if x.tag in ("activity", "service", "receiver", "provider", "application") and (n := x.get(f"{ANDROID}name")):
                yield Fact("resource", n, n, x.tag, ",".join(a.get(f"{ANDROID}name", "") for a in x.iter("action")))
            if x.tag == "uses-permission":
                yield Fact("resource", x.get(f"{ANDROID}name", ""), "", "permission")
        return
    if folder == "values":
        for x in root.iter():
            if x.tag in ("string", "color", "dimen") and x.get("name"):
                yield Fact("resource", x.get("name", ""), f"R.{x.tag}.{x.get('name')}", x.tag, x.text)
        return
    if folder not in ("layout", "navigation", "drawable", "menu"):
        return
    yield Fact("resource", stem, own, folder)
    for x in root.iter():
        ref = x.get(f"{ANDROID}id", "")
        if ref.startswith(("@+id/", "@id/")):
            yield Fact("resource", ref.split("/", 1)[1], f"R.{'navigation' if folder == 'navigation' else 'id'}.{ref.split('/', 1)[1]}", "id")
        for key, value in x.attrib.items():
            if folder == "navigation" and key == f"{ANDROID}name":
                yield Fact("link", value, own, "ConfiguredBy", value)
            elif m := re.fullmatch(r"@(?!\+)(\w+)/(\w+)", value):
                if key != f"{ANDROID}id":
                    yield Fact("link", value, own, "ConfiguredBy", f"R.{m[1]}.{m[2]}")
        if folder == "layout" and "." in x.tag:
            yield Fact("link", x.tag, own, "ConfiguredBy", x.tag)
