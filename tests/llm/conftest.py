import pytest

pytest.importorskip("daram.llm")
