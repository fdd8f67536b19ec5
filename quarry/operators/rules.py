"""The rules as data: what is called what, and which calls matter (fixed values). Users may extend the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STRING = "Ljava/lang/String;"
#: id, description, class, name, signature
CRYPTO_SINKS = [
    ("M10_CIPHER", "javax.crypto.Cipher.getInstance", "Ljavax/crypto/Cipher;", "getInstance", f"({STRING})Ljavax/crypto/Cipher;"),
    ("M10_DIGEST", "java.security.MessageDigest.getInstance", "Ljava/security/MessageDigest;", "getInstance", f"({STRING})Ljava/security/MessageDigest;"),
]
TAINT_SOURCES = [
    ("SRC_INTENT_EXTRA", "Intent.getStringExtra", "Landroid/content/Intent;", "getStringExtra", f"({STRING}){STRING}"),
    ("SRC_SHARED_PREFS", "SharedPreferences.getString", "Landroid/content/SharedPreferences;", "getString", f"({STRING}{STRING}){STRING}"),
    ("SRC_TELEPHONY_IMEI", "TelephonyManager.getDeviceId", "Landroid/telephony/TelephonyManager;", "getDeviceId", f"(){STRING}"),
    ("SRC_SECURE_SETTINGS", "Settings.Secure.getString", "Landroid/provider/Settings$Secure;", "getString", f"(Landroid/content/ContentResolver;{STRING}){STRING}"),
    ("SRC_BUNDLE_STRING", "Bundle.getString", "Landroid/os/Bundle;", "getString", f"({STRING}){STRING}"),
]
#: and the arguments that must all be tainted, counted with the receiver; then those of the corrected rule set
TAINT_SINKS = [
    ("SNK_LOG_DEBUG", "Log.d", "Landroid/util/Log;", "d", f"({STRING}{STRING})I", [1], [1]),
    ("SNK_LOG_ERROR", "Log.e", "Landroid/util/Log;", "e", f"({STRING}{STRING})I", [1], [1]),
    ("SNK_URL_CONSTRUCTOR", "java.net.URL.<init>", "Ljava/net/URL;", "<init>", f"({STRING})V", [0], [1]),
    ("SNK_WEBVIEW_LOAD_URL", "WebView.loadUrl", "Landroid/webkit/WebView;", "loadUrl", f"({STRING})V", [0], [1]),
    ("SNK_SQLITE_EXEC", "SQLiteDatabase.execSQL", "Landroid/database/sqlite/SQLiteDatabase;", "execSQL", f"({STRING})V", [1], [1]),
    ("SNK_SQLITE_RAW_QUERY", "SQLiteDatabase.rawQuery", "Landroid/database/sqlite/SQLiteDatabase;", "rawQuery", f"({STRING}[{STRING})Landroid/database/Cursor;", [1], [1]),
    ("SNK_RUNTIME_EXEC", "Runtime.exec", "Ljava/lang/Runtime;", "exec", f"({STRING})Ljava/lang/Process;", [1], [1]),
]
#: class, name, signature, and the arguments any of which passes its taint to the result
PASSTHROUGHS = [
    (STRING, "valueOf", f"(Ljava/lang/Object;){STRING}", [0]),
    ("Ljava/lang/StringBuilder;", "toString", f"(){STRING}", [0]),
    ("Ljava/lang/StringBuilder;", "append", f"({STRING})Ljava/lang/StringBuilder;", [0, 1]),
    ("Ljava/lang/StringBuilder;", "append", "(Ljava/lang/Object;)Ljava/lang/StringBuilder;", [0, 1]),
]
#: role, class, name, signature; a null signature stands for any
STRUCTURAL_CALLEES = [
    ("javascript", "Landroid/webkit/WebSettings;", "setJavaScriptEnabled", "(Z)V"),
    ("file_access", "Landroid/webkit/WebSettings;", "setAllowFileAccess", "(Z)V"),
    ("interface", "Landroid/webkit/WebView;", "addJavascriptInterface", f"(Ljava/lang/Object;{STRING})V"),
    ("proceed", "Landroid/webkit/SslErrorHandler;", "proceed", "()V"),
    ("file_output", "Landroid/content/Context;", "openFileOutput", f"({STRING}I)Ljava/io/FileOutputStream;"),
    ("exec", "Ljava/lang/Runtime;", "exec", None),
    ("process", "Ljava/lang/ProcessBuilder;", "<init>", None),
]
WORLD_MODES = [1, 2]
SSL_OVERRIDE = ("onReceivedSslError", "(Landroid/webkit/WebView;Landroid/webkit/SslErrorHandler;Landroid/net/http/SslError;)V")


def is_ssl_override(name: str, signature: str) -> bool:
    return (name, signature) == SSL_OVERRIDE


def crypto_sinks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CRYPTO_SINKS, "sink string, description string, class string, name string, signature string")


def structural_callees(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STRUCTURAL_CALLEES, "role string, class string, name string, any_signature string")


def taint_roles(spark: SparkSession, ruleset: str = "reference") -> DataFrame:
    """(role, ord, rule, description, class, name, signature, args): sources, sinks and pass-throughs; ord ranks several matches."""
    if ruleset not in ("reference", "corrected"):
        raise ValueError(f"unknown rule set {ruleset!r}")
    rows = [("source", i, *r, []) for i, r in enumerate(TAINT_SOURCES)]
    rows += [("sink", 100 + i, *r[:5], r[5 if ruleset == "reference" else 6]) for i, r in enumerate(TAINT_SINKS)]
    rows += [("pass", 200 + i, "PASS", "", *r) for i, r in enumerate(PASSTHROUGHS)]
    return spark.createDataFrame(rows, "role string, ord int, rule string, description string, class string, name string, signature string, args array<int>")
