"""A small Go code base as text, by which the tools are asked what they make of
real sources, and the code base's facts."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

from ferngraph.engine import Engine

FILES = {
    "go.mod": "module ex.com/shop\n\ngo 1.22\n",
    "main.go": """package main

import (
	"fmt"
	"net/http"

	"github.com/go-chi/chi/v5"
	"github.com/labstack/echo/v4"

	"ex.com/shop/core"
	db "ex.com/shop/store"
)

var started = build(func() int { return first() })

func build(f func() int) int { return f() }
func first() int             { return 1 }

func init() {}

func init() {}

func main() {
	s := core.Item{Name: "x"}
	s.Save()
	go worker()
	go worker()
	go func() { helper() }()
	http.HandleFunc("/home", home)
	r := chi.NewRouter()
	r.Get("/items", core.List)
	r.Any(`/raw`, func(w http.ResponseWriter, q *http.Request) {})
	web := newWeb()
	web.GET("/web", handlers[0])
	keep(&s)
	run(1, &db.Disk{})
	fmt.Println(&s)
}

func newWeb() *echo.Echo { return echo.New() }

func keep(v core.Saver) { v.Save() }

func run(n int, to db.RW) int {
	if n > 3 && to != nil {
		to.Write(n)
		return n
	}
	return run(n+1, to)
}

func worker()     { c := &core.Item{}; c.Name = "w" }
func helper()     {}
func deadCaller() { deadTarget() }
func deadTarget() {}
""",
    "core/core.go": """package core

import "fmt"

type Saver interface {
	Save() error
}

type Item struct {
	Name  string
	owner Owner
}

func (i *Item) Save() error {
	i.Name = "saved"
	fmt.Println(i.Name)
	i.owner.Notify()
	return nil
}

type Wrapped struct {
	Item
}

type Deep struct {
	*Wrapped
}

type Hidden struct {
	Item
	Save int
}

type Both struct {
	Item
	Other
}

type Other struct{}

func (Other) Save() error { return nil }

type Owner struct{ Count int }

func (o *Owner) Notify() { o.Count++ }

func First(a []int) int {
	total := 0
	for _, x := range a {
		total += x
	}
	return total
}

func Second(a []int) int {
	total   := 0
	for _, x := range a {
		total += x
	}
	return   total
}

func List() {}

func unused(x int) string {
	switch {
	case x > 1 && x < 9:
		return "a"
	case x == 0:
		for i := 0; i < x; i++ {
			if i > 2 {
				return "b"
			}
		}
	}
	return "c"
}
""",
    "core/core_test.go": "package core\n\nfunc broken( {\n",
    "core/bad.go": "package core\n\nfunc broken( {\n",
    "store/store.go": """package storage

import (
	"io"
	"sync"
	"sync/atomic"

	"ex.com/shop/core"
)

type R interface{ Read(n int) int }

type W interface{ Write(n int) }

type RW interface {
	R
	W
}

type Streams interface {
	io.Closer
	RW
}

type Disk struct {
	mu   sync.Mutex
	size int
	hits int64
}

func (d *Disk) Read(n int) int { return n }
func (d *Disk) Write(n int)    { d.size = n }
func (d Disk) Close() error    { return nil }

type Tape struct{ Disk }

type Bare struct{}

func (Bare) Close(x int) error { return nil }

func (d *Disk) locked() {
	d.mu.Lock()
	d.size++
	d.mu.Unlock()
}

func (d *Disk) counted() {
	atomic.AddInt64(&d.hits, 1)
	d.hits = 0
}

func (d *Disk) loose() { d.size-- }

func Start() io.Closer {
	d := new(Disk)
	go d.locked()
	go d.counted()
	go d.loose()
	var s core.Saver = &core.Item{}
	s.Save()
	shut(d)
	return d
}

func shut(c interface{ Close() error }) { c.Close() }
""",
    "rpc/rpc.go": """package rpc

import "google.golang.org/grpc"

var Greeter_ServiceDesc = grpc.ServiceDesc{
	ServiceName: "shop.v1.Greeter",
	HandlerType: (*GreeterServer)(nil),
	Methods: []grpc.MethodDesc{
		{MethodName: "Hello", Handler: _Greeter_Hello},
	},
	Streams: []grpc.StreamDesc{
		{StreamName: "Talk", Handler: _Greeter_Talk, ServerStreams: true, ClientStreams: true},
		{StreamName: "Feed", Handler: _Greeter_Feed, ServerStreams: true},
	},
	Metadata: "greeter.proto",
}

type GreeterServer interface{ Hello() }

func RegisterGreeterServer(s grpc.ServiceRegistrar, srv GreeterServer) {
	s.RegisterService(&Greeter_ServiceDesc, srv)
}
""",
    "cmd/serve/main.go": """package main

import (
	"google.golang.org/grpc"

	"ex.com/shop/core"
	"ex.com/shop/rpc"
)

type server struct{ core.Item }

func (s *server) Hello() {}

func main() {
	g := grpc.NewServer()
	rpc.RegisterGreeterServer(g, &server{})
}
""",
    "ring/a/a.go": 'package a\n\nimport "ex.com/shop/ring/b"\n\nfunc A() { b.B() }\n',
    "ring/b/b.go": 'package b\n\nimport "ex.com/shop/ring/a"\n\nfunc B() { a.A() }\n',
}

_made: dict[str, tuple[Engine, str]] = {}


def tree(spark: SparkSession) -> tuple[Engine, str]:
    """An engine and the folder of the code base, once an application; in the
    folder that all executors share, if one is named and it is a mounted one."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
        if shared and "://" not in shared:
            os.makedirs(shared, exist_ok=True)
        top = Path(tempfile.mkdtemp(prefix="gotree-", dir=shared if shared and "://" not in shared else None))
        top.chmod(0o755)
        for name, text in FILES.items():
            (top / name).parent.mkdir(parents=True, exist_ok=True)
            (top / name).write_text(text)
        _made[app] = Engine(spark), str(top)
    return _made[app]
