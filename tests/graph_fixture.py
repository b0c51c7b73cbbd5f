"""The small graph of the fixtures: two controllers, a service interface with an abstract base, an inner class, a library."""

import json

PKG = "com.ex."


def document():
    classes, methods, fields, calls, inh, over, ends = [], [], [], [], [], [], []

    def cls(name, kind="CLASS", extends=None, implements=()):
        classes.append({"fqn": PKG + name, "name": name.split("$")[-1], "kind": kind, "filePath": f"src/{name}.java", "lineStart": 1, "lineEnd": 90, "packageName": "com.ex", "superClass": extends and PKG + extends, "interfaces": [PKG + i for i in implements], "modifiers": [], "annotations": []})
        if extends:
            inh.append({"childFqn": PKG + name, "parentFqn": PKG + extends, "relationType": "EXTENDS"})
        for i in implements:
            inh.append({"childFqn": PKG + name, "parentFqn": PKG + i, "relationType": "IMPLEMENTS"})

    def method(owner, sig, line=10):
        methods.append({"fqn": f"{PKG}{owner}#{sig}", "name": sig.split("(")[0], "classFqn": PKG + owner, "returnType": "void", "parameters": [], "isConstructor": False, "isVarArgs": False, "filePath": f"src/{owner}.java", "lineStart": line, "lineEnd": line + 9, "body": "{ work(); }", "javadoc": "/** Does it. */"})

    def call(a, b, line):
        full = lambda x: x if x.startswith("java.") else PKG + x
        calls.append({"callerFqn": full(a), "calleeFqn": full(b), "line": line})

    cls("BaseSvc", "ABSTRACT_CLASS"), cls("UserSvc", "INTERFACE"), cls("UserSvcImpl", extends="BaseSvc", implements=["UserSvc"]), cls("OrderSvc", extends="BaseSvc")
    cls("UserCtl"), cls("OrderCtl"), cls("AdminCtl", extends="UserCtl"), cls("Ent"), cls("Outer"), cls("Outer$Inner")
    S = "java.lang.String"
    for o, sig in [("BaseSvc", "save(com.ex.Ent)"), ("BaseSvc", "hook()"), ("UserSvc", f"create({S})"), ("UserSvcImpl", f"create({S})"), ("UserSvcImpl", "hook()"), ("OrderSvc", f"place(long,{S})"), ("UserCtl", f"post({S})"), ("OrderCtl", "put(long)"), ("AdminCtl", "wipe()"), ("Ent", f"setName({S})")]:
        method(o, sig)
    for o, f, t in [("UserCtl", "users", "UserSvc"), ("OrderCtl", "orders", "OrderSvc")]:
        fields.append({"fqn": f"{PKG}{o}#{f}", "name": f, "classFqn": PKG + o, "type": PKG + t, "filePath": f"src/{o}.java", "lineStart": 3})
    over += [{"methodFqn": PKG + f"UserSvcImpl#create({S})", "overridesFqn": PKG + f"UserSvc#create({S})"}, {"methodFqn": PKG + "UserSvcImpl#hook()", "overridesFqn": PKG + "BaseSvc#hook()"}]
    impl = f"UserSvcImpl#create({S})"
    call(f"UserCtl#post({S})", f"UserSvc#create({S})", 10)
    call(impl, "BaseSvc#save(com.ex.Ent)", 20), call(impl, "BaseSvc#save(com.ex.Ent)", 22), call(impl, "Outer$Inner#Inner()", 21)
    call("BaseSvc#save(com.ex.Ent)", "BaseSvc#hook()", 30), call("OrderCtl#put(long)", f"OrderSvc#place(long,{S})", 40), call(f"OrderSvc#place(long,{S})", "BaseSvc#save(com.ex.Ent)", 50)
    call("AdminCtl#wipe()", "BaseSvc#save(com.ex.Ent)", 60), call("UserSvcImpl#hook()", f"Ent#setName({S})", 70), call("UserSvcImpl#hook()", "java.util.List#add(java.lang.Object)", 71)
    for verb, path, ctl, sig in [("POST", "/users", "UserCtl", f"post({S})"), ("PUT", "/orders", "OrderCtl", "put(long)"), ("DELETE", "/admin", "AdminCtl", "wipe()")]:
        ends.append({"path": path, "httpMethod": verb, "controllerFqn": PKG + ctl, "handlerMethodFqn": f"{PKG}{ctl}#{sig}", "produces": [], "consumes": []})
    ann = [{"targetFqn": PKG + "UserCtl", "targetKind": "CLASS", "annotationFqn": "org.web.RestController", "params": {}}]
    spring = {"beans": [{"name": "userSvcImpl", "classFqn": PKG + "UserSvcImpl", "scope": "singleton", "type": "SERVICE"}], "endpoints": ends, "injections": []}
    return {"version": "1", "exportType": "full", "timestamp": "2024-01-01T00:00:00Z", "project": {"name": "ex"}, "classes": classes, "methods": methods, "fields": fields, "callGraph": calls, "inheritance": inh, "methodOverrides": over, "annotations": ann, "spring": spring, "modules": [{"name": "app", "type": "MAVEN", "dependencies": [{"moduleName": "lib", "scope": "COMPILE"}]}], "stats": {"callEdgeCount": len(calls)}}


def save(doc, path):
    with open(path, "w") as f:
        json.dump(doc, f, indent=1)
    return str(path)


def delta(**upserted):
    empty = {k: [] for k in ("classes", "methods", "fields", "callGraph", "inheritance", "methodOverrides", "annotations")}
    return {"version": "1", "exportType": "delta", "timestamp": "2024-01-02T00:00:00Z", "deleted": {"classes": [], "methods": [], "fields": []}, "upserted": empty | upserted, "spring": None, "modules": None}
