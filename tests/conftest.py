import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codeloom.session import local_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


TYPES = "id long, file_id long, name string, kind string, parent string, line int, depth int"
FILES = "id long, path string, project string, module string, language string, mtime long, relative_path string, path_lower string, basename_lower string"
MEMBERS = "id long, type_id long, file_id long, name string, member_kind string, line int, is_static boolean, specifiers string"
ASSETS = "id long, path string, name string, content_path string, folder string, project string, extension string, mtime long, asset_class string, parent_class string"


def make_files(spark, *rows):
    """Rows of (id, path, project, module, language, mtime)."""
    full = []
    for i, path, project, module, language, mtime in rows:
        plain = path.replace("\\", "/").lower()
        base = plain.rsplit("/", 1)[-1]
        full.append((i, path, project, module, language, mtime, None, plain, base.rsplit(".", 1)[0] if base.rfind(".") > 0 else base))
    return spark.createDataFrame(full, FILES)


def make_types(spark, *rows):
    """Rows of (id, file_id, name, kind, parent, line)."""
    return spark.createDataFrame([(*r, None) for r in rows], TYPES)


def make_members(spark, *rows):
    return spark.createDataFrame(list(rows), MEMBERS)


def make_assets(spark, *rows):
    """Rows of (id, name, asset_class, parent_class)."""
    return spark.createDataFrame([(i, f"/c/{n}.uasset", n, f"/Game/A/{n}", "/Game/A", "P", ".uasset", 0, c, p) for i, n, c, p in rows], ASSETS)
