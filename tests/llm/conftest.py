import pytest

pytest.importorskip("framewright.llm")
