"""Test inputs as SQL views over the given tables.

The text runs unchanged in Spark SQL and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


DECORATED_PAGES = r"""
SELECT page_id, url,
  replace(replace(html, '<head>', '<head>'
    || CASE WHEN page_id % 2 = 0 THEN '<meta name="author" content=" Author ' || CAST(page_id % 7 AS STRING) || ' ">' ELSE '' END
    || CASE WHEN page_id % 3 = 0 THEN '<meta property="article:author" content="Alt Author">' ELSE '' END
    || CASE WHEN page_id % 10 = 5 THEN '<meta itemprop="author" content="Item Author">' ELSE '' END
    || CASE page_id % 6 WHEN 0 THEN '<meta property="article:published_time" content="2026-09-22T23:30:00-08:00">'
                        WHEN 1 THEN '<meta name="date" content="September 5, 2026">'
                        WHEN 2 THEN '<meta name="publishdate" content="not a date">'
                        WHEN 3 THEN '<meta name="publication_date" content="5 Sep 2026">' ELSE '' END
    || CASE WHEN page_id % 4 = 0 THEN '<meta name="description" content="Summary ' || CAST(page_id AS STRING) || '">' ELSE '' END
    || CASE WHEN page_id % 4 = 1 THEN '<meta property="og:description" content="OG summary">' ELSE '' END
    || CASE WHEN page_id % 5 = 0 THEN '<meta name="keywords" content="alpha, beta,,  gamma ">' ELSE '' END
    || CASE WHEN page_id % 5 <> 4 THEN '<meta property="og:title" content="Social ' || CAST(page_id % 9 AS STRING) || '!">' ELSE '' END
    || '<meta property="og:image" content="https://cdn.example.com/' || CAST(page_id AS STRING) || '.png">'),
  '<article>', '<article>'
    || CASE WHEN page_id % 6 IN (2, 4) THEN '<time datetime="2026-01-0' || CAST(1 + page_id % 9 AS STRING) || '">then</time>' ELSE '' END
    || CASE WHEN page_id % 3 = 0 THEN '<img src="/img/p' || CAST(page_id % 4 AS STRING) || '.PNG?w=1" alt="My Photo" width="300">' ELSE '' END
    || CASE WHEN page_id % 3 = 1 THEN '<img data-src="https://cdn.example.com/a.webp" width="50%">' ELSE '' END
    || CASE WHEN page_id % 3 = 0 THEN '<img src="http://10.0.0.7/x.svg" alt="My Photo">' ELSE '' END
    || '<p>See <a href="../rel/' || CAST(page_id % 8 AS STRING) || '?q=1">rel</a>, <a href="#frag">frag</a> and <a href="mailto:a@b.example">mail</a>; <mark>hot</mark> <del>old</del> <math>x+y</math>.</p>') AS html
FROM pages
"""

NOTE_SOURCES = r"""
SELECT doc_id, 'https://notes.example.org/n/' || CAST(doc_id AS STRING) AS url,
  'Heading ' || CAST(doc_id % 11 AS STRING) || chr(10) || chr(10) || text || chr(10) || chr(10)
  || CASE doc_id % 8
     WHEN 0 THEN 'git fetch --all' || chr(10) || 'docker ps' || chr(10)
     WHEN 1 THEN '```python' || chr(10) || 'cd not_fenced_again' || chr(10) || '```' || chr(10)
     WHEN 2 THEN 'Alpha' || chr(10) || '  Beta of it' || chr(10) || '    Gamma below' || chr(10)
     WHEN 3 THEN '> <blockquote class="callout-info"><p>Mind > the ! gap</p><p>Body</p></blockquote>' || chr(10)
     WHEN 4 THEN '> plain quote' || chr(10) || '> second' || chr(10) || '>tight' || chr(10)
     WHEN 5 THEN 'call(*a*) and call(*a*, *b*) <mark>m</mark> <!-- c --> <s>gone</s>' || chr(10)
     WHEN 6 THEN '[in](/x/../y) [out](https://o.example/) ![i](pic.png) [[A|B]] ![[keep.png]] [t](tel:1)' || chr(10)
     ELSE '<math display="block">a^2</math> <span class="math">E</span> <pre class="mermaid">A--&gt;B</pre>' || chr(10) END
  || chr(10) || '- ^deadbeef' || chr(10) || 'tail line ^kept-id' || chr(10) || '| a | b |' AS markdown
FROM documents
"""

FETCH_ATTEMPTS = r"""
SELECT 'https://s' || CAST(user_id % 20 AS STRING) || '.example.com/u/' || CAST(user_id AS STRING) AS url,
  event_id AS seq, ts AS attempted_at,
  CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 404 WHEN 'view' THEN CAST(NULL AS INT) ELSE 200 END AS status_code,
  CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'network' END ELSE CAST(NULL AS STRING) END AS failure,
  CASE event_id % 3 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'text/html' ELSE '' END AS content_type
FROM events
"""

URL_CANDIDATES = r"""
SELECT CAST(page_id AS BIGINT) AS seq, url FROM pages
UNION ALL SELECT * FROM (VALUES (CAST(-1 AS BIGINT),'ftp://example.com/a'),(-2,'example.com/no-scheme'),(-3,'http:///nohost'),(-4,'http://localhost/x'),
 (-5,'http://LOCALHOST.localdomain/x'),(-6,'http://10.1.2.3/x'),(-7,'http://172.31.255.255/x'),(-8,'http://172.32.0.0/x'),(-9,'http://100.64.0.1:8080/x'),
 (-10,'http://169.254.169.254/meta'),(-11,'http://[::1]/x'),(-12,'http://[fd00::1]/x'),(-13,'http://[fe80::1]/x'),(-14,'http://[2001:db8::1]/x'),
 (-15,'HTTPS://user:pw@127.0.0.1/x'),(-16,'http://8.8.8.8/x'),(-17,'http://010.0.0.1/x'),(-18,'')) AS t(seq, url)
"""

IMAGE_RESPONSES = r"""
SELECT page_id AS seq,
  'https://cdn.example.com/' || CAST(page_id AS STRING)
  || CASE page_id % 5 WHEN 0 THEN '.PNG?w=1' WHEN 1 THEN '.webp#x' WHEN 2 THEN '' WHEN 3 THEN '.php' ELSE '.a%2Ejpg' END AS url,
  CASE WHEN page_id % 7 = 0 THEN 404 WHEN page_id % 11 = 0 THEN 302 ELSE 200 END AS status_code,
  CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/octet-stream' ELSE '' END AS content_type
FROM pages
"""

RESPONSES = r"""
SELECT page_id AS seq, url,
  CASE page_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'text/html' WHEN 2 THEN 'text/html; charset=no-such' ELSE '' END AS content_type,
  html AS text
FROM pages
"""

VIEWS = {
    "decorated_pages": DECORATED_PAGES,
    "note_sources": NOTE_SOURCES,
    "fetch_attempts": FETCH_ATTEMPTS,
    "url_candidates": URL_CANDIDATES,
    "image_responses": IMAGE_RESPONSES,
    "responses": RESPONSES,
}

# Note titles that collide, and names already taken, for the conflict rules.
NAME_REQUESTS = r"""
SELECT page_id AS seq,
  CASE page_id % 11 WHEN 0 THEN 'Note' WHEN 1 THEN 'Note 2' WHEN 2 THEN 'note' WHEN 3 THEN 'Note 2 2' WHEN 4 THEN 'Log ' || CAST(page_id % 60 AS STRING)
    WHEN 5 THEN 'Log' WHEN 6 THEN 'Note 02' WHEN 7 THEN 'Solo ' || CAST(page_id AS STRING) || 'x' WHEN 8 THEN 'Log' WHEN 9 THEN 'Note 5' ELSE '!!!' END AS title
FROM pages
"""

CATALOGUE = r"""
SELECT * FROM (VALUES ('note.md'), ('note-3.md'), ('log-4.md'), ('solo-7x.md'), ('log-2-2.md'), ('other-9.md')) AS t(path)
"""

# Four images a page whose names meet, and how fetching them ended: some of each name fail.
GALLERY = "\nUNION ALL ".join(
    rf"""SELECT page_id, url, {n} AS pos, CASE WHEN page_id % 6 = 1 AND {n} = 3 THEN '/g/0.png' ELSE '/g/{n}.png' END AS src,
  CASE (page_id * 3 + {n * n}) % 11 WHEN 0 THEN 'Pic' WHEN 1 THEN 'Pic' WHEN 2 THEN 'Pic 2' WHEN 3 THEN 'Shot' WHEN 4 THEN 'Shot' WHEN 5 THEN 'Shot'
    WHEN 6 THEN 'Calm' WHEN 7 THEN 'Calm 2' WHEN 8 THEN 'Pic 3' WHEN 9 THEN 'Calm' ELSE 'Own ' || CAST(page_id AS STRING) || 'x{n}' END AS alt,
  CAST(100 + {n} AS INT) AS width
FROM pages"""
    for n in range(4)
)

GALLERY_RESPONSES = "\nUNION ALL ".join(
    rf"""SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/g/{n}.png' AS url,
  CASE WHEN (page_id * 3 + {n * n}) % 11 IN (6, 7, 9) THEN 200 WHEN (page_id + {n}) % 3 = 0 THEN 404 ELSE 200 END AS status_code,
  CASE WHEN page_id % 4 = 0 THEN 'text/html' ELSE 'image/png' END AS content_type
FROM pages"""
    for n in range(4)
)

# URLs asked for, some twice, some never fetched or not valid, and the log of fetching them.
_PAGE_URL = "'https://r.example/' || CAST(page_id AS STRING)"
REQUESTED_URLS = rf"""
SELECT page_id * 3 AS seq, CASE WHEN page_id % 13 = 12 THEN 'ftp://r.example/' || CAST(page_id AS STRING) ELSE {_PAGE_URL} END AS url FROM pages
UNION ALL SELECT page_id * 3 + 1, {_PAGE_URL} FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT page_id * 3 + 2, {_PAGE_URL} || '/never' FROM pages WHERE page_id % 9 = 0
"""

FETCH_LOG = "\nUNION ALL ".join(
    rf"""SELECT {_PAGE_URL} AS url, page_id + {n} AS seq,
  CASE WHEN page_id % 11 = 0 THEN 404 WHEN page_id % 11 = 1 THEN 503 WHEN page_id % 11 = 2 AND {n} < 2 THEN 500 WHEN page_id % 11 = 3 THEN CAST(NULL AS INT) ELSE 200 END AS status_code,
  CASE WHEN page_id % 11 = 3 THEN CASE WHEN {n} = 2 THEN 'timeout' ELSE 'reset' END ELSE CAST(NULL AS STRING) END AS failure,
  CASE page_id % 3 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'text/html' ELSE '' END AS content_type,
  CASE WHEN page_id % 11 = 4 THEN '' WHEN page_id % 11 = 2 AND {n} < 2 THEN 'not this one' ELSE html END AS text
FROM pages"""
    for n in range(4)
)

# Pages with end tags left out: of headings, paragraphs, list items and cells.
VIEWS["open_pages"] = r"""
SELECT page_id, url, CASE page_id % 3
  WHEN 0 THEN replace(replace(replace(html, '</h1>', ''), '</p>', ''), '</li>', '')
  WHEN 1 THEN replace(replace(replace(html, '</h1>', '<p>'), '<h2>', '<table><tr><td>'), '</h2>', '<td>cell</table>') ELSE html END AS html
FROM pages
"""
VIEWS["requested_urls"] = REQUESTED_URLS
VIEWS["fetch_log"] = FETCH_LOG
VIEWS["name_requests"] = NAME_REQUESTS
VIEWS["catalogue"] = CATALOGUE
VIEWS["gallery"] = GALLERY
VIEWS["gallery_responses"] = GALLERY_RESPONSES

_SOURCES = {"note_sources": "documents", "fetch_attempts": "events"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a test table out over all cores: it is one small file."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view in Spark."""
    source = _SOURCES.get(name, "pages")
    key = {"documents": "doc_id", "events": "user_id"}.get(source, "page_id")
    table = spread(spark.read.parquet(f"{sf_dir}/{source}.parquet"), key)
    text = VIEWS[name].replace(f"FROM {source}", "FROM {source}")
    return spark.sql(text, source=table) if "{source}" in text else spark.sql(text)


def cte(*names: str) -> str:
    """The fixture views as the WITH list of an oracle query."""
    return ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
