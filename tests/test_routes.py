"""Routes that programs declare by calls."""

from __future__ import annotations

from sinktrace.jobs import scan
from sinktrace.operators import routes

FILES = "path string, lang string, text string"
RAILS = """Rails.application.routes.draw do
  get '/users/:id', to: 'users#show'
  # post '/no', to: 'users#no'
  post("/a",
       as: :x,
       to: 'admin/blog_posts#make')
  get PATH, to: 'users#index'
  get '/plain'
  resources :blog_posts, only: [:index,
    :show]
  resources :tags, except: [:new, :edit, :destroy] do
    get :top, to: 'tags#top'
  end
  resources :all
end
"""


def test_rails_and_laravel_routes(spark):
    php = "<?php\n// Route::get('/no', [X::class, 'no']);\nRoute::get('/u/{id}', [App\\Http\\UserController::class, 'show']);\nRoute::post(\n  '/p', 'PostController@store');\nRoute::get('/f', function () {});\n"
    rows = [("config/routes.rb", "ruby", RAILS), ("routes/web.php", "php", php), ("a.rb", "ruby", None), ("b.py", "python", "get '/x', to: 'a#b'"), ("c.rb", "ruby", "")]
    found = {(r.verb, r.route, r.class_name, r.action) for r in routes.declared_routes(spark.createDataFrame(rows, FILES)).collect()}
    seven = [("GET", "", "index"), ("POST", "", "create"), ("GET", "/new", "new"), ("GET", "/:id/edit", "edit"), ("GET", "/:id", "show"), ("PATCH", "/:id", "update"), ("DELETE", "/:id", "destroy")]
    expected = {("GET", "/users/:id", "UsersController", "show"), ("POST", "/a", "BlogPostsController", "make"), ("GET", "?", "UsersController", "index"), ("GET", "top", "TagsController", "top")}
    expected |= {("GET", "/blog_posts", "BlogPostsController", "index"), ("GET", "/blog_posts/:id", "BlogPostsController", "show")}
    expected |= {(v, "/tags" + s, "TagsController", a) for v, s, a in seven if a not in ("new", "edit", "destroy")}
    expected |= {(v, "/all" + s, "AllController", a) for v, s, a in seven}
    expected |= {("GET", "/u/{id}", "UserController", "show"), ("POST", "/p", "PostController", "store")}
    assert found == expected
    assert routes.declared_routes(spark.createDataFrame([], FILES)).count() == 0


KTOR = """fun Application.module() {
  routing {
    route("/api") {
      // get("/no") { }
      route("/v1/{tenant}") {
        get("/users/{id}") {
          call.respond(find(call))
        }
        post { save("}") }
      }
      delete("/x") { client.get("y") { } }
    }
    get("/open") {
"""


def test_ktor_blocks_add_their_prefixes(spark):
    found = {tuple(r) for r in routes.nested_handlers(spark.createDataFrame([("M.kt", "kotlin", KTOR), ("n.kt", "kotlin", None), ("e.kt", "kotlin", ""), ("a.java", "java", 'get("/x") { }')], FILES)).collect()}
    assert found == {("M.kt", "GET", "/api/v1/{tenant}/users/{id}", 6, 8), ("M.kt", "POST", "/api/v1/{tenant}", 9, 9), ("M.kt", "DELETE", "/api/x", 11, 11)}


def test_declared_routes_and_handlers_are_entries_of_a_scan(spark):
    rows = [
        ("config/routes.rb", "ruby", "get '/run/:cmd', to: 'jobs#run'\n"),
        ("app/jobs_controller.rb", "ruby", "class JobsController\n  def run\n    go(1)\n  end\n  def other\n    go(2)\n  end\nend\n"),
        ("M.kt", "kotlin", 'fun module() {\n  route("/api") {\n    get("/x") {\n      work(1)\n    }\n  }\n}\nfun work(a: Int) {\n  println(a)\n}\n'),
    ]
    frame = spark.createDataFrame(rows, FILES)
    methods, _, edges = scan.call_graph(frame)
    marks = {(r.node, r.reason, r.definitive) for r in scan.entry_marks(spark, frame, methods).collect()}
    assert ("app/jobs_controller.rb#run#2", "GET /run/:cmd", True) in marks and not [m for m in marks if "#other#" in m[0] and m[2]]
    handler = [m for m in marks if m[1] == "GET /api/x"]
    assert len(handler) == 1 and handler[0][2]
    assert (handler[0][0], "M.kt#work#8") in {(r.caller, r.callee) for r in edges.collect()}
