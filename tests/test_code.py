"""Extraction from source code, on files of our own."""

from loomgraph.extract.code import byte_cut, calls, extract


def facts(path, source, lang):
    rows = extract(path, source, lang)
    symbols = {(r["kind"], r["name"]): r for r in rows if r.get("kind")}
    by_ordinal = {r["ordinal"]: r["name"] for r in rows if r.get("kind")}
    refs = {(by_ordinal[r["ordinal"]], r["edge_kind"], r["ref_name"]) for r in rows if r.get("edge_kind")}
    parents = {(r["kind"], r["name"]): by_ordinal.get(r["parent"]) for r in rows if r.get("kind")}
    return symbols, refs, parents


RUST = '''
//! fn not_this() {}
pub struct Account { id: u64 }
pub(crate) struct Pair(u8, u8);
pub enum Fault { Missing, Denied(String), Late { at: u64 } }
pub trait Store { fn get(&self, id: u64) -> Option<Account>; fn has(&self) -> bool { self.get(1).is_some() } }
impl Store for Account {
    fn get(&self, id: u64) -> Option<Account> {
        let c = '{'; let s = "fn fake() {";
        lookup(id).map(|x| crate::deep::wrap(x))
    }
}
pub async fn open(name: &str) -> Result<Account, Fault> {
    println!("{}", name);
    let a = Account::load::<u8>(name);
    inner::call(a)
}
fn lookup<T>(id: T) -> Option<Account> where T: Copy { None }
macro_rules! twice { ($x:expr) => { $x; $x }; }
'''


def test_rust():
    s, refs, parents = facts("src/a.rs", RUST, "rust")
    assert ("Function", "not_this") not in s and ("Function", "fake") not in s
    assert s["Struct", "Account"]["visibility"] == "Public" and s["Struct", "Pair"]["visibility"] == "Crate"
    assert {k[1] for k in s if k[0] == "EnumVariant"} == {"Missing", "Denied", "Late"}
    assert parents["EnumVariant", "Late"] == "Fault" and parents["Function", "has"] == "Store"
    assert s["Function", "open"]["signature"] == "pub async fn open(name: &str) -> Result<Account, Fault>"
    assert s["Function", "lookup"]["visibility"] == "Private"
    assert {("open", "Calls", "load"), ("open", "Calls", "call"), ("get", "Calls", "lookup"), ("get", "Calls", "wrap"), ("Account", "Implements", "Store")} <= refs
    assert not any(r[2] == "println" for r in refs)
    assert ("Macro", "twice") in s and s["Function", "open"]["start_line"] == 13


C = """#ifndef BASE_H
#define BASE_H
#define LIMIT 10
#define MAXOF(a, b) ((a) > (b) ? (a) : (b))
struct Peer;
enum State { IDLE, BUSY = 3, /* DOWN, */ DEAD };
struct Link { int fd; struct Peer *peer; };
static struct Link *find_link(struct Link *all, int fd) {
    if (fd > 0) { return scan(all, fd); }
    return 0;
}
int link_send(struct Link *l, const char *s)
{
    enum State st = IDLE;
    return find_link(l, MAXOF(1, 2))->fd;
}
#endif
"""


def test_c():
    s, refs, _ = facts("a.h", C, "c")
    assert {k[1] for k in s if k[0] == "Struct"} == {"Link"}
    assert {k[1] for k in s if k[0] == "Function"} == {"find_link", "link_send"}
    assert {k[1] for k in s if k[0] == "EnumVariant"} == {"IDLE", "BUSY", "DEAD"}
    assert {"LIMIT", "MAXOF", "BASE_H"} == {k[1] for k in s if k[0] == "Macro"}
    assert s["Function", "find_link"]["visibility"] == "Private" and s["Function", "link_send"]["visibility"] == "Public"
    assert s["Function", "link_send"]["signature"] == "int link_send(struct Link *l, const char *s)"
    assert {("link_send", "Calls", "find_link"), ("find_link", "Calls", "scan")} <= refs
    assert sum(r.get("ref_name") == "Link" and r.get("edge_kind") == "TypeRef" for r in extract("a.h", C, "c")) >= 3


PYTHON = '''
import os
class Base(object):
    """doc"""
    def run(self, x: int = 1) -> int:
        def inner():
            return os.path.join("a")
        return helper(x) + inner()

def _hidden(): return 1
async def fetch(url):
    await client.get(url)
'''


def test_python():
    s, refs, parents = facts("a.py", PYTHON, "python")
    assert s["Function", "run"]["signature"] == "def run(self, x: int = 1) -> int:"
    assert s["Function", "_hidden"]["visibility"] == "Private" and s["Struct", "Base"]["visibility"] == "Public"
    assert parents["Function", "inner"] == "run" and parents["Function", "run"] == "Base"
    assert {("run", "Calls", "helper"), ("run", "Calls", "join"), ("inner", "Calls", "join"), ("fetch", "Calls", "get"), ("Base", "Implements", "object")} <= refs
    assert extract("b.py", "def broken(:", "python")[1:] == []


TS = """
export interface Person { name: string }
export enum Level { Low, High }
export class Registry extends Base implements Person {
  private find(name: string): Person | null { return lookup(name); }
  async load() { await this.find(`x ${y}`); }
}
export function login(user: string): boolean { return verify(user) && new Registry().load(); }
const pick = (a: number) => { return login(a); };
"""


def test_typescript():
    for lang in ("typescript", "tsx", "javascript"):
        s, refs, parents = facts("a.ts", TS, lang)
        assert {("Trait", "Person"), ("Enum", "Level"), ("Struct", "Registry"), ("Function", "login"), ("Function", "find"), ("Function", "load"), ("Function", "pick")} <= s.keys()
        assert parents["Function", "find"] == "Registry"
        assert {("login", "Calls", "verify"), ("find", "Calls", "lookup"), ("load", "Calls", "find"), ("pick", "Calls", "login")} <= refs


GO = """package m
type (
	Inner struct { A int }
)
type User struct { Name string }
type Auth interface { Login(name string) error }
func NewUser(name string) *User { return &User{Name: name} }
func (u *User) Login(name string) error {
	if name == "" { return fmt.Errorf("no { name") }
	return check(NewUser(name))
}
"""


def test_go():
    s, refs, _ = facts("a.go", GO, "go")
    assert {k[1] for k in s if k[0] == "Struct"} == {"User", "Inner"} and {k[1] for k in s if k[0] == "Trait"} == {"Auth"}
    assert {k[1] for k in s if k[0] == "Function"} == {"NewUser", "Login"}
    assert s["Function", "Login"]["signature"] == "func (u *User) Login(name string) error" and s["Function", "NewUser"]["signature"] is None
    assert {("Login", "Calls", "NewUser"), ("Login", "Calls", "Errorf"), ("Login", "Calls", "check")} <= refs


JAVA = """package a;
public class Service implements Provider, Closeable {
    private final Map<String, User> users = new HashMap<>();
    public Service(int n) { super(); }
    @Override
    public User login(String name) throws Fault {
        User u = new User(name);
        return find(name);
    }
    protected boolean verify(String a) { return a.equals("x;{"); }
    private User find(String n) { return users.get(n); }
    enum Role { ADMIN, GUEST(1); int x; }
}
record Session(String id) {}
interface Provider { User login(String name); }
"""


def test_java():
    s, refs, parents = facts("A.java", JAVA, "java")
    assert {("Struct", "Service"), ("Struct", "Session"), ("Trait", "Provider"), ("Enum", "Role"), ("EnumVariant", "ADMIN"), ("EnumVariant", "GUEST")} <= s.keys()
    assert {k[1] for k in s if k[0] == "Function"} == {"Service", "login", "verify", "find"}
    assert (s["Function", "verify"]["visibility"], s["Function", "find"]["visibility"], s["Struct", "Session"]["visibility"]) == ("Private", "Private", "Crate")
    assert parents["Function", "find"] == "Service"
    assert {("Service", "Implements", "Provider"), ("Service", "Implements", "Closeable"), ("login", "Calls", "find"), ("login", "Calls", "User")} <= refs


CSHARP = """namespace App;
public interface IAuth { bool Check(string name); }
public class Auth : IAuth
{
    public string Name { get; set; }
    public Auth(string name) { Name = name; }
    public bool Check(string name) { return Find(name) != null && new Session(name).Open(); }
    private User Find(string name) => Store.Get(name);
    internal static void Reset() { }
}
public enum Role { Admin, Guest = 2 }
public record Session(string Id);
"""


def test_members_on_one_line():
    s, _, parents = facts("A.java", "interface A { int go(String a); boolean has(); }\nenum E { X, Y(1) { void f() { g(); } }, Z(2); }\nclass B { void run() { int x = f(1); g(x); A a = new A(x); } }\n", "java")
    assert s["Function", "go"]["signature"] == "int go(String a);" and parents["Function", "has"] == "A"
    assert {k[1] for k in s if k[0] == "Function"} == {"go", "has", "run", "f"} and {k[1] for k in s if k[0] == "EnumVariant"} == {"X", "Y", "Z"}
    s, _, parents = facts("A.cs", "interface A { int Go(int a); string Name { get; } }\nclass B { int Run() { var y = f(1); g(y); return h(y); } }\n", "csharp")
    assert s["Function", "Go"]["signature"] == "int Go(int a);" and {k[1] for k in s if k[0] == "Function"} == {"Go", "Run"}


def test_csharp():
    s, refs, _ = facts("A.cs", CSHARP, "csharp")
    assert {("Trait", "IAuth"), ("Struct", "Auth"), ("Struct", "Session"), ("Enum", "Role"), ("EnumVariant", "Guest")} <= s.keys()
    assert {"Auth", "Check", "Find", "Reset"} <= {k[1] for k in s if k[0] == "Function"}
    assert s["Function", "Reset"]["visibility"] == "Crate" and s["Function", "Find"]["visibility"] == "Private"
    assert {("Auth", "Implements", "IAuth"), ("Check", "Calls", "Find"), ("Check", "Calls", "Session"), ("Find", "Calls", "Get")} <= refs


KOTLIN = """package a
data class User(val name: String)
interface Provider { fun login(name: String): User? }
class Service(private val n: Int) : Provider {
    override fun login(name: String): User? {
        return find(name)
    }
    private fun find(name: String): User? = users[name]
    internal fun verify(a: String) = a.isValid()
    companion object { fun create(): Service = Service(1) }
}
enum class Role { ADMIN, GUEST; fun up() = 1 }
sealed class Fault(m: String) : Exception(m)
object Config { fun timeout() = 5 }
"""


def test_kotlin():
    s, refs, _ = facts("A.kt", KOTLIN, "kotlin")
    assert {("Struct", "User"), ("Struct", "Service"), ("Struct", "Fault"), ("Struct", "Config"), ("Trait", "Provider"), ("Enum", "Role"), ("EnumVariant", "ADMIN"), ("EnumVariant", "GUEST")} <= s.keys()
    assert {"login", "find", "verify", "create", "timeout", "up"} <= {k[1] for k in s if k[0] == "Function"}
    assert (s["Function", "login"]["visibility"], s["Function", "find"]["visibility"], s["Function", "verify"]["visibility"]) == ("Public", "Private", "Crate")
    assert s["Function", "find"]["signature"] == "private fun find(name: String): User?" and s["Function", "verify"]["signature"] == "internal fun verify(a: String)"
    assert {("Service", "Implements", "Provider"), ("login", "Calls", "find"), ("create", "Calls", "Service")} <= refs


CPP = """
#define TWICE(x) ((x) * 2)
namespace a {
enum class Mode { On, Off };
class Shape : public Base {
 public:
  virtual ~Shape() {}
  int area() const { return helper(1); }
};
template <typename T> T largest(T a, T b) { return a > b ? a : b; }
int Shape::grow(int n) { return area() + largest<int>(n, 1); }
}
"""


def test_cpp():
    s, refs, _ = facts("a.cpp", CPP, "cpp")
    assert {("Enum", "Mode"), ("Struct", "Shape"), ("EnumVariant", "Off"), ("Macro", "TWICE"), ("Function", "area")} <= s.keys()
    assert any(k[0] == "Function" and k[1].endswith("grow") for k in s) and ("Function", "largest") in s
    assert any(r[1:] == ("Calls", "helper") for r in refs) and any(r[1:] == ("Calls", "largest") for r in refs)


def test_byte_cut():
    assert byte_cut("é" * 100, 200) == "é" * 100
    assert byte_cut("é" * 101, 200) == "é" * 100 + "..." and byte_cut("a" + "é" * 101, 200) == "a" + "é" * 99 + "..."


def test_calls_skip_keywords():
    assert calls("if (a) { while (b) { run(c); } } a.b::<T>().act(1)", "rust") >= {"run", "act"}
    assert "if" not in calls("if (x) {}", "c")
