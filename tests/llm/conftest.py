import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def queries():
    import corpus_pipeline
    from docketflow.llm.queries import CATALOG

    return CATALOG.queries | {"pipeline": corpus_pipeline.run}
