"""Faults that no query shows."""

import ast
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
FILES = sorted(p for p in ROOT.rglob("*.py") if ".git" not in p.parts)


@pytest.mark.parametrize("path", FILES, ids=lambda p: str(p.relative_to(ROOT)))
def test_no_definition_shadows_another(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, (ast.Module, ast.ClassDef)):
            names = [x.name for x in node.body if isinstance(x, (ast.FunctionDef, ast.ClassDef))]
            assert len(names) == len(set(names)), [n for n in names if names.count(n) > 1]
