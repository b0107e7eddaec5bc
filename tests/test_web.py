"""Facts of Python, Node, Angular and React sources, and how files are assigned."""

from pyspark.sql import functions as F

from corpusindex.facts.front import parse_angular, parse_react
from corpusindex.facts.node import parse_node
from corpusindex.facts.python import extract_python_facts, parse_python
from corpusindex.operators import web
from corpusindex.operators.changes import with_hash

PYTHON = '''
from dataclasses import dataclass

@dataclass
class Point:
    x: int
    y: int = 0
    def move(self, by: int) -> "Point":
        inner: int = 3
        return self

@router.get(
    "/users/{id}",
)
async def read(
    id: int,
    db: Session = Depends(get_db), user=Depends(auth.current),
):
    text = "class Fake: pass"

urlpatterns = [
    path("products/", views.ProductList.as_view(), name="p"),
    re_path(r"^old/$", old),
]
'''


def test_python_facts():
    facts = parse_python(PYTHON)
    assert [t["name"] for t in facts["types"]] == ["Point"] and facts["types"][0]["decorators"] == ["@dataclass"]
    assert facts["types"][0]["fields"] == [{"name": "x", "type": "int"}, {"name": "y", "type": "int"}]
    assert facts["types"][0]["methods"][0]["sig"] == "(self, by: int) -> 'Point'"
    read = facts["functions"][0]
    assert read["async"] and read["deps"] == ["get_db", "auth.current"] and read["decorators"] == ["@router.get('/users/{id}')"]
    assert facts["assigns"][0]["name"] == "urlpatterns"


def test_python_model(spark):
    flask = '@app.route("/orders", methods=["POST"])\ndef make(): pass\n@app.route("/orders")\ndef all_(): pass\n'
    rows = [("r", "src/shop/users/api.py", PYTHON), ("r", "shop/orders/api.py", flask), ("r", "main.py", "x = 1"), ("r", "bad.py", "def ("), ("r", "none.py", None)]
    facts = web.assign_python(extract_python_facts(with_hash(spark.createDataFrame(rows, "repo string, path string, content string"))))
    got = {r["path"]: (r["ctx_id"], r["parse_error"] is not None) for r in facts.collect()}
    assert got == {
        "src/shop/users/api.py": ("shop/shop.users", False), "shop/orders/api.py": ("shop/shop.orders", False), "main.py": ("r/r", False),
        "bad.py": ("r/r", True), "none.py": ("r/r", False),
    }
    routes = web.python_routes(facts)
    flows = {r["flow"] for r in web.python_flows(routes, web.python_di(facts)).collect()}
    assert flows == {
        "GET /users/{id} → read → get_db → auth.current", "ANY /products/ → views.ProductList", "ANY /^old/$ → old", "POST /orders → make", "GET /orders → all_",
    }
    found = {r["ctx_id"]: r["framework"] for r in web.context_framework(web.python_signals(facts, routes), "python").collect()}
    assert found == {"shop/shop.users": "fastapi", "shop/shop.orders": "flask", "r/r": "python"}


def test_features(spark):
    rows = [("app.ts",), ("users/a.ts",), ("features/chat/a.ts",), ("features/a.ts",), ("modules/x/y/a.ts",)]
    table = spark.createDataFrame(rows, "p string").select("p", web.feature_of(F.col("p"), web.CONTAINERS["angular"]).alias("f"))
    assert [r["f"] for r in table.collect()] == ["app", "users", "features.chat", "features", "modules.x"]


def test_directories_of_files_are_never_broadcast(spark, tmp_path):
    names = [("a", "lib/x.ts"), ("a", "other/x.ts"), ("b", "x.ts")]
    spark.createDataFrame(names, "repo string, path string").coalesce(1).write.parquet(f"{tmp_path}/files")
    rows = [("a", "lib", "lib/")] + [("a", f"p{i}", f"projects/p{i}") for i in range(500)]
    spark.createDataFrame(rows, "repo string, name string, root string").coalesce(1).write.parquet(f"{tmp_path}/projects")
    files, projects = spark.read.parquet(f"{tmp_path}/files"), spark.read.parquet(f"{tmp_path}/projects")
    out = web.assign_feature(files, projects, "angular")
    assert "BuildLeft" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.repo, r.path): r.ctx_id for r in out.collect()}
    assert got == {("a", "lib/x.ts"): "lib/app", ("a", "other/x.ts"): "lib/app", ("b", "x.ts"): "b/app"}


def test_node_facts():
    source = '''
import { Controller } from '@nestjs/common';
@Controller('users')
export class UsersController {
  constructor(private readonly users: UsersService) {}
  @Get() list() { return []; }
  @Delete(':id')
  @HttpCode(204)
  async remove(@Param('id') id: string) {}
}
router.post('/orders', validate, orders.create);
router.post('/orders', other);
map.get(key); // app.get('/no', x)
'''
    facts = parse_node(source)
    assert [(r["verb"], r["path"], r["target"]) for r in facts["routes"]] == [
        ("GET", "/users", "UsersController.list"), ("DELETE", "/users/:id", "UsersController.remove"), ("POST", "/orders", "orders.create"),
    ]
    assert facts["types"][0]["ctorDeps"] == ["UsersService"] and facts["fw"] == ["nestjs"]


def test_angular_facts():
    source = '''
@Component({ selector: 'app-users' })
export class UserListComponent {
  @Input() title = '';
  rows = input<string[]>([]);
  private api = inject(ApiService);
  private apiUrl = `${environment.apiUrl}/categories`;
  constructor(private readonly users: UserService, name: string, private http: HttpClient) {}
  drop(id: string) { return this.http.delete(`${this.apiUrl}/${id}`); }
  list = httpResource(() => ({ url: this.apiUrl, method: 'POST' }));
}
export const authGuard: CanActivateFn = (r) => { const a = inject(AuthService); return a.ok(); };
export const routes: Routes = [
  { path: '', redirectTo: 'users' },
  { path: 'users', component: UserListComponent,
    canActivate: [authGuard, scopeGuard('aura:admin')] },
  { path: 'chat', loadChildren: () => import('./chat/routes') },
];
'''
    facts = parse_angular(source)
    own = facts["types"][0]
    assert own["ctorDeps"] == ["UserService", "HttpClient", "ApiService"] and own["inputs"] == ["title", "rows"]
    assert own["http"] == [{"verb": "DELETE", "url": "{apiUrl}/categories/{id}"}, {"verb": "POST", "url": "{apiUrl}/categories"}]
    assert facts["functionals"][0]["deps"] == ["AuthService"] and facts["functionals"][0]["kind"] == "guard"
    assert [(r["path"], r["target"], r["kind"], r["guards"]) for r in facts["routes"]] == [
        ("", "users", "redirect", []), ("users", "UserListComponent", "component", ["authGuard", "scopeGuard('aura:admin')"]), ("chat", "./chat/routes", "lazy-children", []),
    ]


def test_react_facts():
    source = '''
export default function UserList({ title, limit: n }: Props) {
  const [a, setA] = useState<string>('');
  const { users } = useUsers();
  return <ul>{users}</ul>;
}
export const Cart = (props: CartProps) => <Card {...props} />;
const helper = (x: number) => x + 1;
export const useUsers = () => { useEffect(() => {}, []); return useQuery<User>(); };
class Legacy extends React.Component { render() { return null; } }
const router = createBrowserRouter([{ path: '/users', element: <UserList /> }]);
const App = () => <Route path="/cart" element={<Cart />} />;
'''
    facts = parse_react(source)
    found = {f["name"]: f for f in facts["functionals"]}
    assert set(found) == {"UserList", "Cart", "useUsers", "Legacy", "App"}
    assert found["UserList"]["hooks"] == ["useState", "useUsers"] and found["UserList"]["deps"] == ["useUsers"] and found["UserList"]["props"] == ["title", "limit"]
    assert found["useUsers"]["kind"] == "hook" and found["useUsers"]["deps"] == ["useQuery"] and found["Legacy"]["class"]
    assert [(r["path"], r["target"]) for r in facts["routes"]] == [("/users", "UserList"), ("/cart", "Cart")]
