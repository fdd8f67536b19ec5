import io
import zipfile

import pytest

from quarry.tables import DexTables
from tests.engine import images


@pytest.fixture(scope="session")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("dex")
    for name, make in images.ALL.items():
        (out / f"{name}.dex").write_bytes(make().bytes())
    (out / "zero.dex").write_bytes(bytes(0x70))
    (out / "tiny.dex").write_bytes(b"dex")
    broken = bytearray(images.mini().bytes())
    broken[0x3C:0x40] = (len(broken) + 0x100).to_bytes(4, "little")
    (out / "bounds.dex").write_bytes(bytes(broken))
    apk = io.BytesIO()
    with zipfile.ZipFile(apk, "w") as z:
        for name, data in (("classes2.dex", images.secrets().bytes()), ("classes.dex", images.mini().bytes()), ("classes10.dex", images.mini().bytes()), ("assets/x.dex", images.crypto().bytes()), ("bad.dex", b"no"), ("readme.txt", b"x")):
            z.writestr(name, data)
    (out / "multi.apk").write_bytes(apk.getvalue())
    (out / "torn.apk").write_bytes(b"PK\x03\x04 torn")
    return out


@pytest.fixture(scope="session")
def tables(spark, folder):
    t = DexTables.load(spark, str(folder))
    yield t
    t.release()


@pytest.fixture(scope="session")
def one(spark, folder):
    """Tables of one image by name."""
    return lambda name, **kw: DexTables.load(spark, str(folder / f"{name}.dex"), **kw)
