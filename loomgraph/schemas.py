"""Fixed schemas of the export documents and of the tables built from them."""

# The published input contract, field by field.
_ANN = "array<struct<fqn:string,params:map<string,string>>>"
CLASS = f"fqn:string,name:string,kind:string,modifiers:array<string>,genericParams:array<string>,filePath:string,lineStart:int,lineEnd:int,packageName:string,enclosingClass:string,superClass:string,interfaces:array<string>,annotations:{_ANN}"
METHOD = f"fqn:string,name:string,classFqn:string,returnType:string,parameters:array<struct<name:string,type:string,annotations:array<string>>>,modifiers:array<string>,isConstructor:boolean,isVarArgs:boolean,throwsTypes:array<string>,annotations:{_ANN},filePath:string,lineStart:int,lineEnd:int,body:string,javadoc:string"
FIELD = f"fqn:string,name:string,classFqn:string,type:string,modifiers:array<string>,annotations:{_ANN},filePath:string,lineStart:int"
CALL = "callerFqn:string,calleeFqn:string,line:int,filePath:string,receiverType:string"
INHERITANCE = "childFqn:string,parentFqn:string,relationType:string"
OVERRIDE = "methodFqn:string,overridesFqn:string"
SPRING = (
    "beans:array<struct<name:string,classFqn:string,scope:string,profile:string,dependencies:array<string>,type:string>>,"
    "endpoints:array<struct<path:string,httpMethod:string,controllerFqn:string,handlerMethodFqn:string,produces:array<string>,consumes:array<string>>>,"
    "injections:array<struct<targetClassFqn:string,targetFieldOrParam:string,injectedBeanName:string,injectedClassFqn:string,injectionType:string>>"
)
MODULE = "name:string,type:string,sourceRoots:array<string>,resourceRoots:array<string>,testSourceRoots:array<string>,dependencies:array<struct<moduleName:string,scope:string>>,coordinates:struct<groupId:string,artifactId:string,version:string>"
ANNOTATION = "targetFqn:string,targetKind:string,annotationFqn:string,params:map<string,string>"
_FACTS = f"classes:array<struct<{CLASS}>>,methods:array<struct<{METHOD}>>,fields:array<struct<{FIELD}>>,callGraph:array<struct<{CALL}>>,inheritance:array<struct<{INHERITANCE}>>,methodOverrides:array<struct<{OVERRIDE}>>,annotations:array<struct<{ANNOTATION}>>"
EXPORT = f"struct<version:string,exportType:string,timestamp:string,project:struct<name:string,basePath:string,jdkVersion:string>,{_FACTS},spring:struct<{SPRING}>,modules:array<struct<{MODULE}>>,diagnostics:array<struct<elementFqn:string,elementKind:string,type:string,message:string>>,stats:map<string,bigint>>"
DELTA = f"struct<version:string,exportType:string,timestamp:string,basedOnTimestamp:string,changedFiles:array<string>,deleted:struct<classes:array<string>,methods:array<string>,fields:array<string>>,upserted:struct<{_FACTS}>,spring:struct<{SPRING}>,modules:array<struct<{MODULE}>>,stats:map<string,bigint>>"

#: table -> (key columns, DDL); node tables first
NODES = {
    "class": ("fqn", "fqn string, name string, kind string, filePath string, lineStart int, lineEnd int, packageName string, enclosingClass string, superClass string, external boolean"),
    "method": ("fqn", "fqn string, name string, classFqn string, returnType string, isConstructor boolean, filePath string, lineStart int, lineEnd int, body string, javadoc string, external boolean"),
    "field": ("fqn", "fqn string, name string, classFqn string, type string, filePath string, lineStart int"),
    "bean": ("name", "name string, classFqn string, scope string, profile string, type string"),
    "endpoint": ("id", "id string, path string, httpMethod string, controllerFqn string, handlerMethodFqn string"),
    "module": ("name", "name string, type string"),
    "annotation": ("fqn", "fqn string, name string"),
}
EDGES = {
    "calls": "src string, dst string, line int",
    "has_method": "src string, dst string",
    "has_field": "src string, dst string",
    "extends": "src string, dst string",
    "implements": "src string, dst string",
    "overrides": "src string, dst string",
    "annotated_with": "src string, dst string, kind string",
    "handles": "src string, dst string",
    "injects": "src string, dst string, field string, type string",
    "module_depends": "src string, dst string, scope string",
}
LABELS = {"class": "Class", "method": "Method", "field": "Field", "bean": "SpringBean", "endpoint": "Endpoint", "module": "Module", "annotation": "Annotation"}
