"""Routes of single paths, and middleware of nested apps."""

from glyphmill.operators.fileroutes import file_routes

ROUTES = {
    "src/routes/+page.svelte": "/", "src/routes/blog/[slug]/+page.svelte": "/blog/:slug", "a/src/routes/(x)/(y)/b/+server.js": "/b", "src/routes/[...all]/+page.ts": "/*all", "src/routes/[[...opt]]/+page.ts": "/*opt",
    "src/routes/[[l]]/c/+error.svelte": "/:l?/c", "src/routes/[a=int]/+page.server.js": "/:a", "routes/a-b/+page.svelte": "/a-b", "app/pages/index.vue": "/", "pages/users/[id].vue": "/users/:id", "pages/a/index/b.vue": "/a/index/b",
    "server/api/hello.ts": "/api/hello", "x/server/api/users/index.post.ts": "/api/users", "server/api/users/[id].delete.js": "/api/users/:id", "server/api/index.get.ts": "/api",
}


def test_routes(spark):
    other = ["src/routes/blog/Card.svelte", "src/lib/+x.ts", "pages/readme.md", "server/apis/a.ts", "routes.ts", None]
    found = file_routes(spark.createDataFrame([(p,) for p in [*ROUTES, *ROUTES, *other]], "path string")).collect()
    assert {r["path"]: r["route"] for r in found} == ROUTES and len(found) == len(ROUTES)
    assert {r["method"] for r in found} == {None, "POST", "DELETE", "GET"}


def test_middleware(spark):
    paths = ["a/routes/+layout.ts", "a/routes/+layout.server.ts", "a/routes/x/+layout.js", "a/routes/x/y/+page.svelte", "a/routes/xy/+page.svelte", "b/routes/x/y/+page.svelte", "a/middleware/log.global.ts", "a/pages/p.vue", "b/pages/p.vue", "middleware/top.global.js", "a/server/api/q.ts"]
    found = {r["path"]: r["middleware"].split(",") for r in file_routes(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert found["a/routes/x/y/+page.svelte"] == ["a/routes/+layout.server.ts", "a/routes/+layout.ts", "a/routes/x/+layout.js"]
    assert found["a/routes/xy/+page.svelte"] == ["a/routes/+layout.server.ts", "a/routes/+layout.ts"] and found["b/routes/x/y/+page.svelte"] == [""] == found["a/server/api/q.ts"]
    assert found["a/pages/p.vue"] == ["middleware/top.global.js", "a/middleware/log.global.ts"] and found["b/pages/p.vue"] == ["middleware/top.global.js"]
    assert found["a/routes/+layout.ts"] == ["a/routes/+layout.server.ts"]
