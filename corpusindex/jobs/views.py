"""Views over the test tables, each one SQL text that Spark and DuckDB both read.

A view names its tables as {documents}, {benchmark} and so on; `sql_for` gives DuckDB's form, `view` Spark's.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "decisions_v": """
        SELECT 'r' || CAST(doc_id % 3 AS STRING) AS repo,
               source || '/' || CAST(doc_id AS STRING) AS id,
               source AS domain,
               CASE doc_id % 4 WHEN 0 THEN 'architecture' WHEN 1 THEN 'technical' WHEN 2 THEN 'functional' ELSE 'convention' END AS type,
               CASE WHEN doc_id % 11 = 0 THEN 'superseded' WHEN doc_id % 7 = 0 THEN 'proposed' ELSE 'active' END AS status,
               CASE WHEN doc_id % 5 = 0 THEN 'local' WHEN doc_id % 9 = 0 THEN 'global' ELSE NULL END AS scope,
               CAST(2020 + doc_id % 5 AS STRING) || '-0' || CAST(1 + doc_id % 9 AS STRING) || '-' || CAST(10 + doc_id % 19 AS STRING) AS date,
               'Decision ' || CAST(doc_id AS STRING) || ' of ' || source AS title,
               text AS decision,
               'Chosen for ' || lang AS rationale,
               'Context of ' || source AS context,
               CASE WHEN doc_id % 13 = 0 THEN source || '/' || CAST(doc_id - 20 AS STRING) WHEN doc_id % 17 = 0 THEN 'gone/1' ELSE NULL END AS supersedes,
               CASE WHEN doc_id % 6 = 0 THEN source || '/' || CAST(doc_id + 60 AS STRING) WHEN doc_id % 19 = 0 THEN 'gone/2' ELSE NULL END AS conflict,
               source || '/' || lang || '/doc_' || CAST(doc_id AS STRING) || '.txt' AS path,
               lang, source, doc_id
        FROM {documents}""",
    "files_v": """
        SELECT 'r' || CAST(doc_id % 3 AS STRING) AS repo,
               source || '/' || lang || '/doc_' || CAST(doc_id AS STRING) || '.txt' AS path,
               text AS content, source AS module, source || '/' || lang AS ctx_id, doc_id
        FROM {documents}""",
    "old_files_v": """
        SELECT repo, path, CASE WHEN doc_id % 5 = 0 THEN content || ' changed' ELSE content END AS content, ctx_id,
               CASE WHEN doc_id % 29 = 0 THEN 'bad' ELSE NULL END AS parse_error
        FROM {files_v} WHERE doc_id % 7 <> 0
        UNION ALL
        SELECT repo, 'gone/' || path AS path, content, ctx_id, CAST(NULL AS STRING) AS parse_error
        FROM {files_v} WHERE doc_id % 23 = 0""",
    "queries_v": """
        SELECT 'r' || CAST(item_id % 3 AS STRING) AS repo, 'q' || CAST(item_id AS STRING) AS query_id, text AS q,
               CASE item_id % 3 WHEN 0 THEN 'feature' WHEN 1 THEN 'routes' ELSE NULL END AS scope
        FROM {benchmark}""",
    "ledger_v": """
        SELECT 'r' || CAST(item_id % 3 AS STRING) AS repo, item_id AS entry, text AS q, 'answer ' || CAST(item_id AS STRING) AS a,
               CASE item_id % 4 WHEN 0 THEN 'feature' WHEN 1 THEN 'routes' ELSE NULL END AS scope,
               CASE item_id % 5 WHEN 0 THEN 'old' WHEN 1 THEN NULL ELSE 'new' END AS engine,
               'ctx' || CAST(item_id % 9 AS STRING) AS ctx,
               CASE WHEN item_id % 7 = 0 THEN 'stale' ELSE 'h' || CAST(item_id % 9 AS STRING) END AS h,
               CASE WHEN item_id % 2 = 0 THEN item_id % 4 ELSE NULL END AS hits
        FROM {benchmark}""",
    "log_v": """
        SELECT CAST(user_id AS STRING) AS log_id, event_id, ts, event_type || ' ' || CAST(event_id AS STRING) AS text
        FROM {events}""",
    "messages_v": """
        SELECT 'r' || CAST(conv_id % 3 AS STRING) AS repo, CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS msg_id, role,
               CASE WHEN (conv_id + turn) % 5 = 0 THEN 'From now on: ' || text WHEN (conv_id + turn) % 7 = 0 THEN text || ' by convention' ELSE text END AS text
        FROM {conversations}""",
    "costs_v": """
        SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS query,
               l_returnflag AS route, CAST(floor(l_quantity) AS BIGINT) AS used, CAST(floor(l_extendedprice / 100) AS BIGINT) AS raw,
               l_linenumber <= 3 AS structural
        FROM {lineitem}""",
    "functional_v": """
        SELECT 'r' || CAST(p_partkey % 3 AS STRING) AS repo, p_brand AS module, p_brand || '/' || CAST(p_partkey AS STRING) AS ctx_id,
               CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE 'Manages ' || p_name || ' of ' || lower(p_type) END AS purpose,
               p_name AS cap1, CASE WHEN p_size % 2 = 0 THEN 'handle ' || lower(p_type) ELSE NULL END AS cap2,
               'h' || CAST(p_size AS STRING) AS src_hash
        FROM {part}""",
    "javasrc_v": """
        SELECT 'r' || CAST(c_nationkey % 2 AS STRING) AS repo,
               'mod' || CAST(c_nationkey % 5 AS STRING) || '/src/C' || CAST(c_custkey AS STRING) || 'Controller.java' AS path,
               'package com.shop.n' || CAST(c_nationkey AS STRING) || ';' || chr(10) || '// class Fake { }' || chr(10)
               || '@RestController' || chr(10) || '@RequestMapping("/c' || CAST(c_custkey AS STRING) || '/")' || chr(10)
               || 'public class C' || CAST(c_custkey AS STRING) || 'Controller {' || chr(10)
               || '  private final String note = "not } a brace {";' || chr(10)
               || '  public C' || CAST(c_custkey AS STRING) || 'Controller(final Map<String, Long> m, N' || CAST(c_nationkey AS STRING) || 'Service svc) { if (m == null) { return; } }' || chr(10)
               || '  @GetMapping("/{id}")' || chr(10) || '  public S' || CAST(c_custkey % 7 AS STRING) || 'Entity get(@PathVariable("id") String id) { return null; }' || chr(10)
               || CASE WHEN c_mktsegment = 'BUILDING' THEN '  @org.x.PostMapping(value = "make",' || chr(10) || '     consumes = "json")' || chr(10) || '  public List<String> create(' || chr(10) || '      @RequestBody(required = true) C' || CAST(c_custkey AS STRING) || 'Dto dto, int n) throws E { for (;;) { } }' || chr(10)
                       WHEN c_mktsegment = 'MACHINERY' THEN '  @RequestMapping(method = RequestMethod.PUT)' || chr(10) || '  void touch() { }' || chr(10) ELSE '' END
               || '  public String getName() { return "x"; }' || chr(10) || '}' || chr(10) AS content
        FROM {customer}
        UNION ALL
        SELECT 'r' || CAST(n_nationkey % 2 AS STRING), 'mod' || CAST(n_nationkey % 5 AS STRING) || '/src/N' || CAST(n_nationkey AS STRING) || 'Service.java',
               'package com.shop.n' || CAST(n_nationkey AS STRING) || ';' || chr(10) || '@Service' || chr(10) || 'public class N' || CAST(n_nationkey AS STRING) || 'Service extends Base<S0Entity> implements Runnable, Closeable {' || chr(10)
               || '  /* class Hidden { */' || chr(10) || '  @Autowired' || chr(10) || '  private R' || CAST(n_regionkey AS STRING) || 'Repository repo;' || chr(10)
               || '  @Value("$' || '{limit:' || CAST(n_nationkey AS STRING) || '}")' || chr(10) || '  private int limit = 3;' || chr(10)
               || '  public List<S1Entity> run(String s, int[] n) { char c = ' || chr(39) || '}' || chr(39) || '; return null; }' || chr(10) || '}' || chr(10)
        FROM {nation}
        UNION ALL
        SELECT 'r' || CAST(n_nationkey % 2 AS STRING), 'mod0/src/R' || CAST(n_regionkey AS STRING) || 'Repository.java',
               'package com.shop.data;' || chr(10) || '@Repository' || chr(10) || 'public interface R' || CAST(n_regionkey AS STRING) || 'Repository extends JpaRepository<S' || CAST(n_regionkey AS STRING) || 'Entity, Long> { }' || chr(10)
        FROM {nation} GROUP BY n_nationkey % 2, n_regionkey
        UNION ALL
        SELECT 'r' || CAST(s_nationkey % 2 AS STRING), 'mod' || CAST(s_nationkey % 5 AS STRING) || '/src/S' || CAST(s_suppkey AS STRING) || 'Entity.java',
               'package com.shop.n' || CAST(s_nationkey AS STRING) || ';' || chr(10) || '@Entity' || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN '@Table(name = "t_' || CAST(s_suppkey AS STRING) || '")' || chr(10) ELSE '' END
               || CASE WHEN s_suppkey % 5 = 0 THEN '@ConfigurationProperties("app.s' || CAST(s_suppkey AS STRING) || '")' || chr(10) ELSE '' END
               || 'class S' || CAST(s_suppkey AS STRING) || 'Entity {' || chr(10) || '  @OneToMany(mappedBy = "x")' || chr(10) || '  private List<S1Entity> others;' || chr(10)
               || '  @ManyToOne' || chr(10) || '  S2Entity owner;' || chr(10) || '  enum Kind { A, B; }' || chr(10) || '}' || chr(10)
        FROM {supplier}""",
    "pysrc_v": """
        SELECT 'r' || CAST(p_partkey % 2 AS STRING) AS repo, 'src/shop/pkg' || CAST(p_partkey % 9 AS STRING) || '/m' || CAST(p_partkey AS STRING) || '.py' AS path, p_partkey AS k,
               CASE p_partkey % 3 WHEN 0 THEN
                   'from fastapi import APIRouter, Depends' || chr(10) || 'router = APIRouter()' || chr(10) || 'class Item' || CAST(p_partkey AS STRING) || '(BaseModel):' || chr(10)
                   || '    name: str' || chr(10) || '    size: int = ' || CAST(p_size AS STRING) || chr(10) || chr(10) || '@router.get("/p' || CAST(p_partkey AS STRING) || '/{item_id}")' || chr(10)
                   || 'async def read' || CAST(p_partkey AS STRING) || '(' || chr(10) || '    item_id: int' || CASE WHEN p_size % 2 = 0 THEN ', db=Depends(get_db),' || chr(10) || '    user: User = Depends(auth.current)' ELSE '' END || '):' || chr(10)
                   || '    x = "def fake(): # no"' || chr(10) || '    return x' || chr(10) || 'def helper(y): return y' || chr(10)
                 WHEN 1 THEN
                   'bp = Blueprint("b", __name__)' || chr(10) || '@bp.route("/f' || CAST(p_partkey AS STRING) || '", methods=["GET", "POST"])' || chr(10) || 'def view' || CAST(p_partkey AS STRING) || '():' || chr(10) || '    return 1' || chr(10)
                   || 'class Plain' || CAST(p_partkey AS STRING) || ':' || chr(10) || '    @bp.route("/g' || CAST(p_partkey AS STRING) || '")' || chr(10) || '    def show(self): pass' || chr(10)
                 ELSE
                   'urlpatterns = [' || chr(10) || '    path("d' || CAST(p_partkey AS STRING) || '/", views.D' || CAST(p_partkey AS STRING) || '.as_view(), name="x"),' || chr(10) || '    re_path(r"/e' || CAST(p_partkey AS STRING) || '", handler),' || chr(10) || ']' || chr(10)
                   || 'class Row' || CAST(p_partkey AS STRING) || '(models.Model):' || chr(10) || '    title = models.CharField(max_length=10)' || chr(10)
                   || CASE WHEN p_size % 10 = 0 THEN 'def broken(:' || chr(10) ELSE '' END END AS content
        FROM {part}""",
    "nodesrc_v": """
        SELECT 'r' || CAST(c_custkey % 2 AS STRING) AS repo, 'src/modules/f' || CAST(c_custkey % 9 AS STRING) || '/c' || CAST(c_custkey AS STRING) || '.ts' AS path, c_custkey AS k,
               CASE c_custkey % 3 WHEN 0 THEN
                   'import { Controller } from "@nestjs/common";' || chr(10) || '@Controller("c' || CAST(c_custkey AS STRING) || '/")' || chr(10) || 'export class C' || CAST(c_custkey AS STRING) || 'Controller {' || chr(10)
                   || '  constructor(private readonly svc: S' || CAST(c_custkey AS STRING) || 'Service, @Inject(X) repo: Repo<Y>) {}' || chr(10)
                   || '  @Get(":id")' || chr(10) || '  @UseGuards(G)' || chr(10) || '  async find(@Param("id") id: string) { return `x $' || '{id} }`; }' || chr(10)
                   || '  @Post()' || chr(10) || '  create() { /* @Delete("no") } */ }' || chr(10) || '}' || chr(10)
                   || '@Injectable("app")' || chr(10) || 'export class S' || CAST(c_custkey AS STRING) || 'Service { constructor(private db: Db) {} }' || chr(10)
                   || '@Module({ controllers: [C' || CAST(c_custkey AS STRING) || 'Controller], providers: [S' || CAST(c_custkey AS STRING) || 'Service, P], imports: [] })' || chr(10) || 'export class M' || CAST(c_custkey AS STRING) || 'Module {}' || chr(10)
                 WHEN 1 THEN
                   'const express = require("express");' || chr(10) || 'const router = express.Router();' || chr(10) || 'router.get("/e' || CAST(c_custkey AS STRING) || '", users.list);' || chr(10)
                   || 'router.post("/e' || CAST(c_custkey AS STRING) || '", (req, res) => { res.send(1); });' || chr(10) || 'map.get(key); cache.get("k"); // router.get("/no", x)' || chr(10)
                 ELSE
                   'import fastify from "fastify";' || chr(10) || 'const f = fastify();' || chr(10) || 'fastify.get("/z' || CAST(c_custkey AS STRING) || '", async () => 1);' || chr(10) || 'fastify.get("/z' || CAST(c_custkey AS STRING) || '", again);' || chr(10) END AS content
        FROM {customer}""",
    "ngsrc_v": """
        SELECT 'r' || CAST(p_partkey % 2 AS STRING) AS repo, 'src/app/features/f' || CAST(p_partkey % 9 AS STRING) || '/x' || CAST(p_partkey AS STRING) || '.ts' AS path, p_partkey AS k,
               CASE p_partkey % 3 WHEN 0 THEN 'import { Component } from "@angular/core";' || chr(10) || '@Component({ selector: "app-c' || CAST(p_partkey AS STRING) || '", standalone: true })' || chr(10) || 'export class C' || CAST(p_partkey AS STRING) || 'Component {' || chr(10) || '  @Input() title = "";' || chr(10) || '  @Output() changed = new EventEmitter<string>();' || chr(10) || '  private api = inject(Api' || CAST(p_partkey AS STRING) || 'Service);' || chr(10) || '  constructor(private router: Router, id: string) {}' || chr(10) || '}' || chr(10) || 'export const guard' || CAST(p_partkey AS STRING) || ': CanActivateFn = () => { return inject(Auth' || CAST(p_partkey AS STRING) || ').ok(); };' || chr(10)
                 WHEN 1 THEN '@Injectable({ providedIn: "root" })' || chr(10) || 'export class Api' || CAST(p_partkey AS STRING) || 'Service {' || chr(10) || '  private base = `$' || '{environment.apiUrl}/items' || CAST(p_partkey AS STRING) || '`;' || chr(10) || '  constructor(private http: HttpClient) {}' || chr(10) || '  all() { return this.http.get<Item[]>(this.base); }' || chr(10) || '  make(b: Item) { return this.http.post(`$' || '{this.base}/new`, b); }' || chr(10) || '  drop(id: number) { return this.http.delete(this.unknown); }' || chr(10) || '}' || chr(10) || '@NgModule({ declarations: [A, B], imports: [], exports: [A] })' || chr(10) || 'export class M' || CAST(p_partkey AS STRING) || 'Module {}' || chr(10)
                 ELSE 'export const routes: Routes = [' || chr(10) || '  { path: "", redirectTo: "p' || CAST(p_partkey AS STRING) || '", pathMatch: "full" },' || chr(10) || '  { path: "p' || CAST(p_partkey AS STRING) || '", component: C' || CAST(p_partkey AS STRING) || 'Component, canActivate: [guard' || CAST(p_partkey AS STRING) || ', scope("a,b")] },' || chr(10) || '  { path: "lazy' || CAST(p_partkey AS STRING) || '", loadComponent: () => import("./x' || CAST(p_partkey AS STRING) || '").then((m) => m.X) },' || chr(10) || '  { path: "kids' || CAST(p_partkey AS STRING) || '", children: [] }' || chr(10) || '];' || chr(10) END AS content
        FROM {part}""",
    "oddsrc_v": """
        SELECT 'r' || CAST(p_partkey % 97 AS STRING) AS repo, p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'angular' WHEN 1 THEN 'react' WHEN 2 THEN 'python' ELSE 'node' END AS lang,
               'src/x' || CAST(p_partkey AS STRING) || CASE p_partkey % 4 WHEN 1 THEN '.tsx' WHEN 2 THEN '.py' ELSE '.ts' END AS path,
               CASE p_partkey % 4
                 WHEN 0 THEN 'export class O' || CAST(p_partkey AS STRING) || ' {' || chr(10)
                   || '  constructor(private client: HttpClient, private httpCache: Cache) {}' || chr(10)
                   || '  all() { this.httpCache.get("k"); return this.client.get("/o' || CAST(p_partkey AS STRING) || '"); }' || chr(10) || '}' || chr(10)
                 WHEN 1 THEN 'export const App' || CAST(p_partkey AS STRING) || ' = () => (<Routes>' || chr(10)
                   || '  <Route element={<A />} path="/a' || CAST(p_partkey AS STRING) || '" />' || chr(10)
                   || '  <Route path="/b" component={B} />' || chr(10) || '  <Route index element={<Home />} />' || chr(10) || '</Routes>);' || chr(10)
                 WHEN 2 THEN '@app.get("/q' || CAST(p_partkey AS STRING) || '")' || chr(10) || 'def ok' || CAST(p_partkey AS STRING) || '(a):' || chr(10)
                   || '    print "old"' || chr(10) || '    return 1' || chr(10)
                 ELSE 'const t = `a $' || '{ f(`class Fake $' || '{"}"} {`) } b`;' || chr(10) || 'router.get("/n' || CAST(p_partkey AS STRING) || '", list);' || chr(10)
               END AS content
        FROM {part}""",
    "workspaces_v": """
        SELECT 'r' || CAST(p_partkey % 3 AS STRING) AS repo, p_partkey AS k,
               CASE p_partkey % 4 WHEN 0 THEN 'projects/shop/src/app/features/f' WHEN 1 THEN 'projects/admin/src/pages/f' WHEN 2 THEN 'lib/f' ELSE 'other/f' END
               || CAST(p_partkey % 5 AS STRING) || '/x' || CAST(p_partkey AS STRING) || '.ts' AS path
        FROM {part}""",
    "buildfiles_v": """
        SELECT 'r' || CAST(s_suppkey AS STRING) AS repo, 'pom.xml' AS path,
               '<project><parent><artifactId>up</artifactId></parent>' || CASE WHEN s_suppkey % 2 = 0 THEN '<artifactId>own' || CAST(s_suppkey AS STRING) || '</artifactId>' ELSE '' END || '</project>' AS content
        FROM {supplier}
        UNION ALL SELECT 'r' || CAST(s_suppkey AS STRING), 'web/package.json', CASE WHEN s_suppkey % 3 = 0 THEN '{{' ELSE '{"name": "@org/web' || CAST(s_suppkey AS STRING) || '"}' END FROM {supplier}
        UNION ALL SELECT 'r' || CAST(s_suppkey AS STRING), 'web/src/a.ts', 'x' FROM {supplier} WHERE s_suppkey % 5 = 0
        UNION ALL SELECT 'r' || CAST(s_suppkey AS STRING), 'angular.json', '{"projects": {"shop": {"sourceRoot": "projects/shop/src/"}, "admin": {"root": "projects/admin"}}}' FROM {supplier} WHERE s_suppkey % 2 = 0""",
    "reactsrc_v": """
        SELECT 'r' || CAST(p_partkey % 2 AS STRING) AS repo, 'src/pages/f' || CAST(p_partkey % 9 AS STRING) || '/x' || CAST(p_partkey AS STRING) || '.tsx' AS path, p_partkey AS k,
               CASE p_partkey % 3 WHEN 0 THEN 'import { useState } from "react";' || chr(10) || 'export function Page' || CAST(p_partkey AS STRING) || '({ title, size = 1 }: Props) {' || chr(10) || '  const [x] = useState<number>(1);' || chr(10) || '  const list = useItems' || CAST(p_partkey AS STRING) || '(x);' || chr(10) || '  return <div>{title}</div>;' || chr(10) || '}' || chr(10) || 'const helper' || CAST(p_partkey AS STRING) || ' = (a: number) => a + 1;' || chr(10)
                 WHEN 1 THEN 'export const useItems' || CAST(p_partkey AS STRING) || ' = (q: Query) => {' || chr(10) || '  useEffect(() => {}, []);' || chr(10) || '  return useFetch<Item>(q);' || chr(10) || '};' || chr(10) || 'class Old' || CAST(p_partkey AS STRING) || ' extends React.Component<Props> { render() { return null; } }' || chr(10)
                 ELSE 'export const App' || CAST(p_partkey AS STRING) || ' = () => (<Routes>' || chr(10) || '  <Route path="/r' || CAST(p_partkey AS STRING) || '" element={<Page' || CAST(p_partkey AS STRING) || ' />} />' || chr(10) || '</Routes>);' || chr(10) || 'const router = createBrowserRouter([{ path: "/d' || CAST(p_partkey AS STRING) || '", element: <Page' || CAST(p_partkey AS STRING) || ' /> }]);' || chr(10) END AS content
        FROM {part}""",
}


TABLES = ("customer", "supplier", "nation", "region", "part", "orders", "lineitem", "events", "documents", "benchmark", "conversations")
NAME = re.compile(r"\{(" + "|".join((*VIEWS, *TABLES)) + r")\}")


def sql_for(name: str) -> str:
    """DuckDB's form: a parenthesised query over the registered tables."""
    return "(" + NAME.sub(lambda m: sql_for(m[1]) if m[1] in VIEWS else m[1], VIEWS[name]) + ")"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view or table as a DataFrame; its SQL is analysed at once, so the names it is given meanwhile are free again."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = dict.fromkeys(NAME.findall(VIEWS[name]))
    for other in used:
        view(spark, sf_dir, other).createOrReplaceTempView(f"corpusindex_{other}")
    out = spark.sql(NAME.sub(lambda m: f"corpusindex_{m[1]}", VIEWS[name]))
    for other in used:
        spark.catalog.dropTempView(f"corpusindex_{other}")
    return out
