from __future__ import annotations

import pytest

from millrace.llm import textcore


@pytest.fixture(scope="session")
def docs(spark, sf):
    return textcore.table(spark, sf, "documents")
