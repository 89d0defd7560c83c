import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.session import local_session  # noqa: E402

RELEASE_SCHEMA = (
    "pos long, id string, version_number string, brand string, name string, channel string, "
    "release_date string, ts_ms long, tags array<string>, notes string, url string, license string"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, partitions=4)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("staged")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def releases(spark):
    """Build a release table from dicts; missing fields are null, ``pos`` counts up."""

    def make(*rows):
        fields = [f.split()[0] for f in RELEASE_SCHEMA.split(", ")]
        defaults = [{"pos": i, "id": f"d{i}", "channel": "patch", **r} for i, r in enumerate(rows)]
        return spark.createDataFrame(
            [tuple(r.get(f) for f in fields) for r in defaults], RELEASE_SCHEMA
        )

    return make


@pytest.fixture(scope="session")
def names(spark):
    def make(*listed):
        return spark.createDataFrame(list(enumerate(listed)), "pos long, name string")

    return make


@pytest.fixture(scope="session")
def ask(spark):
    def make(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "question_id long, question string")

    return make
