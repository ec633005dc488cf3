"""Top-level names of the standard library, pinned: those of CPython 3.10 to 3.12 and what earlier and later releases keep; shortest first."""

NAMES = frozenset(
    """
    gc io nt os re uu abc ast bdb bz2 cgi cmd csv dbm dis grp imp nis pdb pty pwd ssl sys tty xml aifc code copy enum glob gzip hmac html http
    json lzma math mmap site spwd stat test this time uuid venv wave zlib array cgitb chunk cmath crypt email errno fcntl heapq netrc pipes
    posix pydoc queue runpy sched shlex smtpd sunau token trace types atexit base64 bisect codecs codeop ctypes curses ftplib getopt imghdr
    locale msilib msvcrt ntpath opcode pickle poplib pprint pstats pyclbr quopri random select shelve shutil signal sndhdr socket string struct
    syslog timeit turtle typing urllib winreg xdrlib xmlrpc zipapp asyncio audioop copyreg decimal difflib doctest filecmp fnmatch getpass
    gettext hashlib idlelib imaplib inspect keyword lib2to3 logging mailbox mailcap marshal nntplib numbers pathlib pkgutil profile pyexpat
    reprlib secrets smtplib sqlite3 tarfile termios tkinter tomllib weakref wsgiref zipfile argparse asynchat asyncore binascii builtins
    cProfile calendar colorsys datetime graphlib operator optparse platform plistlib readline resource symtable tabnanny tempfile textwrap
    tokenize unittest warnings winsound zoneinfo distutils encodings ensurepip fileinput fractions functools importlib ipaddress itertools
    linecache mimetypes posixpath selectors sre_parse sysconfig telnetlib threading traceback zipimport compileall concurrent contextlib
    nturl2path py_compile statistics stringprep subprocess turtledemo webbrowser antigravity collections contextvars dataclasses genericpath
    ossaudiodev pickletools rlcompleter sre_compile tracemalloc unicodedata configparser faulthandler modulefinder socketserver sre_constants
    multiprocessing
    _io _abc _ast _bz2 _csv _imp _md5 _sre _ssl _json _lzma _pyio _sha1 _sha3 _stat _uuid _heapq _queue _bisect _blake2 _codecs _ctypes _curses
    _locale _lsprof _opcode _pickle _py_abc _random _sha256 _sha512 _signal _socket _string _struct _thread _typing _winapi _asyncio _decimal
    _hashlib _sqlite3 _tkinter _weakref _datetime _operator _strptime _symtable _warnings __future__ _functools _pydecimal _markupbase
    _posixshmem _statistics _weakrefset _aix_support _collections _compression _contextvars _elementtree _osx_support _tracemalloc _sitebuiltins
    _compat_pickle _bootsubprocess _multibytecodec _collections_abc _multiprocessing _posixsubprocess _threading_local _frozen_importlib
    _frozen_importlib_external
    """.split()
)
