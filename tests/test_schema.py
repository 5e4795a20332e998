"""Schema catalogs of hand-written DDL."""

from test_reference import spark  # noqa: F401

from reposcope.operators import schema

TEXTS = {
    "quotes": "CREATE TABLE t (a TEXT DEFAULT ')', b INT, c TEXT DEFAULT '--x', d INT, e TEXT DEFAULT 'it''s, (', \"f, g\" INT)",
    "names": "CREATE TABLE t (key TEXT, index_no INT, `unique` INT NOT NULL, [check] VARCHAR(10), key2 INT, INDEX i (key), KEY (key2), UNIQUE KEY u (key2, key), index NUMERIC(3, 1))",
    "postgres": """
      -- Users table; CREATE TABLE not (x INT);
      CREATE TABLE users (
        id   SERIAL   PRIMARY KEY,   -- auto-increment PK
        email\tTEXT   UNIQUE   NOT NULL,
        score DOUBLE PRECISION DEFAULT 0 CHECK (score > 0 AND score NOT IN (1, 2)),
        name character varying(40)
      );
      /* Posts table, CREATE TABLE x (y INT);
         with FK to users */
      CREATE TABLE IF NOT EXISTS public.posts (
        id SERIAL PRIMARY KEY, user_id INTEGER REFERENCES users(id) ON DELETE CASCADE, title TEXT NOT NULL, tags TEXT[] DEFAULT '{}', at TIMESTAMPTZ DEFAULT now(), body TEXT);
      ALTER TABLE ONLY posts ADD CONSTRAINT fk FOREIGN KEY (title) REFERENCES titles(name);
      ALTER TABLE posts ADD COLUMN note TEXT;
    """,
    "mysql": """CREATE TABLE `users` (`id` INT AUTO_INCREMENT PRIMARY KEY, `email` VARCHAR(255) NOT NULL, # a comment, with (
      `parent` BIGINT, kind ENUM('a', 'b)') , UNIQUE (`email`), CONSTRAINT `fk_p` FOREIGN KEY (`parent`) REFERENCES `users` (`id`)) ENGINE=InnoDB DEFAULT CHARSET=utf8;
      create table pairs (a int, b int, primary key (a, b), foreign key (a) references users) engine = MyISAM""",
    "sqlite": "PRAGMA x; CREATE TABLE users (id INTEGER PRIMARY KEY AUTOINCREMENT, email TEXT UNIQUE NOT NULL); CREATE TABLE posts (id INTEGER PRIMARY KEY, user_id INTEGER, FOREIGN KEY (user_id) REFERENCES users(id))",
    "open": "CREATE TABLE broken (a INT, b TEXT",
    "none": "CREATE VIEW v AS SELECT 1", "null": None, "empty": "",
}


def catalog(spark):  # noqa: F811
    rows = schema.schema_catalog(spark.createDataFrame([("r", k, v) for k, v in TEXTS.items()], "repo_id string, path string, source string")).collect()
    return {k: {(r["table_name"], r["name"]): r for r in sorted(rows, key=lambda r: (r["table_no"], r["pos"])) if r["path"] == k} for k in TEXTS}


def test_catalogs(spark):  # noqa: F811
    found = catalog(spark)
    assert [n for _, n in found["quotes"]] == ["a", "b", "c", "d", "e", "f, g"] and [r["pos"] for r in found["quotes"].values()] == list(range(6))
    names = found["names"]
    assert [n for _, n in names] == ["key", "index_no", "unique", "check", "key2", "index"]
    assert [n for (_, n), r in names.items() if r["is_unique"]] == ["key", "key2"] and names["t", "index"]["type"] == "NUMERIC" and not names["t", "unique"]["nullable"] and names["t", "check"]["raw_type"] == "VARCHAR(10)"
    pg = found["postgres"]
    assert [n for t, n in pg if t == "users"] == ["id", "email", "score", "name"] and [n for t, n in pg if t == "posts"] == ["id", "user_id", "title", "tags", "at", "body"] and len(pg) == 10
    assert pg["users", "id"]["auto_increment"] and pg["users", "id"]["pk"] and pg["users", "email"]["is_unique"] and not pg["users", "email"]["nullable"] and pg["users", "score"]["type"] == "NUMERIC"
    assert pg["users", "name"]["raw_type"] == "character varying(40)" and pg["users", "score"]["nullable"] and not pg["users", "score"]["is_unique"]
    assert (pg["posts", "user_id"]["ref_table"], pg["posts", "user_id"]["ref_column"]) == ("users", "id") and (pg["posts", "title"]["ref_table"], pg["posts", "title"]["ref_column"]) == ("titles", "name")
    my = found["mysql"]
    assert {r["engine"] for (t, _), r in my.items() if t == "users"} == {"InnoDB"} and {r["engine"] for (t, _), r in my.items() if t == "pairs"} == {"MyISAM"} and {r["dialect"] for r in my.values()} == {"mysql"}
    assert my["users", "email"]["is_unique"] and my["users", "id"]["auto_increment"] and my["users", "parent"]["ref_table"] == "users" and my["users", "kind"]["raw_type"].startswith("ENUM(")
    assert my["pairs", "a"]["pk"] and my["pairs", "b"]["pk"] and not my["pairs", "b"]["nullable"] and my["pairs", "a"]["ref_column"] == "id"
    lite = found["sqlite"]
    assert all(lite[t, "id"]["auto_increment"] and lite[t, "id"]["pk"] for t in ("users", "posts")) and lite["posts", "user_id"]["ref_table"] == "users" and {r["dialect"] for r in lite.values()} == {"sqlite"}
    assert [n for _, n in found["open"]] == ["a", "b"] and not found["none"] and not found["null"] and not found["empty"]


def test_a_long_text_takes_time_in_proportion(spark):  # noqa: F811
    ddl = "".join(f"CREATE TABLE t{k} (id INT PRIMARY KEY, a TEXT DEFAULT '{'x(' * 50}', b NUMERIC(10, 2), UNIQUE (a));\n" for k in range(3000))
    assert schema.schema_catalog(spark.createDataFrame([("r", "a.sql", ddl)], "repo_id string, path string, source string")).filter("is_unique").count() == 3000
