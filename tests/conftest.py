import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def note(body: str, **keys: str) -> str:
    """A note's text: frontmatter of these keys (YAML values), if any, and the body."""
    front = "".join(f"{k}: {v}\n" for k, v in keys.items())
    return (f"---\n{front}---\n" if keys else "") + body


#: A kitchen garden: plants grow in beds, recipes use plants, and so on.
NOTES = {
    "beds/north.md": note("# North bed\n\nShade until noon, clay soil.\n", type="bed"),
    "beds/south.md": note("Sandy soil, dries out.\n", type="bed", next_to='"[[north]]"', dug="2031-02-11"),
    "diary/spring, first week.md": note("Frost again. The leek rows stand well.\n", type="diary", visits='"[[beds/north]]"'),
    "diary/second week.md": note("Rain.\n", type="diary", mood="~", photos="[]", link='""'),
    "plants/leek.md": note("\n# Leek\n\nA leek wants deep soil.\n", type="plant", grows_in='"[[beds/north]]"'),
    "plants/potato.md": note("# Potato\n", type="plant", grows_in='["[[beds/north]]", "[[beds/south]]"]'),
    "recipes/leek soup.md": note(
        "# Leek and potato soup\n\nSlice the leek, boil the potato, blend the soup.\n",
        type="recipe", serves="4", rated="fair", after='"[[diary/second week]]"', uses='\n  - "[[plants/leek]]"\n  - "[[plants/potato.md]]"',
    ),
    "recipes/fish pie.md": note("# Fish pie\n\nMash the potato.\n", type="recipe", uses='"[[potato|spuds]]"', variant_of='"[[recipes/leek soup#stock]]"'),
    "people/ida, cook.md": note("Ida cooks on Fridays.\n", type="person", likes='"[[recipes/fish pie]], then [[leek soup|the soup]]"'),
    "seeds.md": note("# Seeds to order\n\nGarlic and more leek.\n", type="list", wants='["[[plants/garlic]]", "[[leek]]"]'),
    "loose.md": note("## not a title\nA thought about nothing.\n"),
}


def write_notes(root) -> None:
    for rel, text in NOTES.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    (root / ".hidden").mkdir()
    (root / ".hidden" / "secret.md").write_text("# hidden")


@pytest.fixture
def vault_dir(tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    write_notes(root)
    return root


@pytest.fixture
def vault(spark, tmp_path, vault_dir):
    from quillmesh.catalog import Catalog

    return Catalog(spark, str(tmp_path / "home")).add("main", str(vault_dir))
